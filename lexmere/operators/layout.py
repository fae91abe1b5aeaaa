"""Page layout to text: regions of a page as rows, margins, continuations, words split at breaks.

Regions come from any parser as (doc, page, order, text, top, left, first_left,
bottom, line_height, page_height, size, bold, monospace, trailing_space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MARGIN = 0.05
RUNNING_PAGES = 3
GAP = 0.6
#: of the body size: how far a first line may stand from its block's left edge
SAME_COLUMN = 0.5


def in_margin(page_height: str = "page_height") -> Column:
    """Wholly in the top or bottom twentieth of the page."""
    return (F.col("bottom") <= MARGIN * F.col(page_height)) | (F.col("top") >= (1 - MARGIN) * F.col(page_height))


def body_sizes(spans: DataFrame) -> DataFrame:
    """Each document's text size: the rounded size with the most characters, the smaller of equals."""
    by_size = spans.groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return by_size.groupBy("doc").agg(F.max_by("size", F.struct(F.col("n"), -F.col("size"))).alias("body_size"))


def running_keys(regions: DataFrame) -> DataFrame:
    """(doc, key): margin texts, digits masked, that stand on at least RUNNING_PAGES pages."""
    keyed = regions.where(in_margin()).select("doc", "page", T.digit_mask(F.col("text")).alias("key"))
    return keyed.groupBy("doc", "key").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= RUNNING_PAGES).select("doc", "key")


def without_margins(regions: DataFrame) -> DataFrame:
    """Regions that are no running text and no page number in a margin."""
    keyed = regions.withColumn("key", T.digit_mask(F.col("text")))
    marked = keyed.join(running_keys(regions).withColumn("running", F.lit(True)), ["doc", "key"], "left")
    margin = in_margin() & (F.coalesce("running", F.lit(False)) | F.lower("text").rlike(T.PAGE_NUMBER))
    return marked.where(~margin).drop("key", "running")


def reading_order() -> list[Column]:
    return [F.round("top", 1), F.col("first_left"), F.col("order")]


def overlaps_of(a: Column, b: Column) -> Column:
    """Whether rectangle a (struct left, top, right, bottom) lies by more than half in b."""
    x = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    y = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    area = (a["right"] - a["left"]) * (a["bottom"] - a["top"])
    return (x > 0) & (y > 0) & (area > 0) & (x * y / area > 0.5)


def overlaps(a: str, b: str) -> Column:
    """The same of two columns by name."""
    return overlaps_of(F.col(a), F.col(b))


def continuations(regions: DataFrame, body_size: float | str | None = None) -> DataFrame:
    """Regions with `paragraph`, one number for the regions of a page that continue each other.

    A region is held against the block as it has grown: it continues it in the same column
    (its first line begins within half the body size of the block's left edge, which is the least
    of its regions'), close below the block's last region, when that ends no sentence, neither
    is monospace and it opens with no list marker. An ordered fold over a page's regions, which
    are as many as a page holds. body_size is a number or a column; without one a region's line height counts.
    A column `kind`, where there is one, keeps all but paragraphs apart.
    """
    body = F.col("line_height") if body_size is None else F.col(body_size) if isinstance(body_size, str) else F.lit(float(body_size))
    plain = (F.col("kind") == "paragraph") if "kind" in regions.columns else F.lit(True)
    facts = F.struct(
        F.round("top", 1).alias("_t"), F.col("first_left").alias("_f"), F.col("order").alias("_o"), F.col("top").cast("double").alias("_top"), F.col("bottom").cast("double").alias("_bottom"), F.col("left").cast("double").alias("_left"),
        F.col("line_height").cast("double").alias("_height"), body.cast("double").alias("_body"), F.coalesce(plain & ~F.col("monospace"), F.lit(False)).alias("_open"),
        F.coalesce(F.col("text").rlike(T.PARAGRAPH_END), F.lit(False)).alias("_ends"), F.coalesce(F.col("text").rlike(T.LIST_MARKER), F.lit(False)).alias("_listed"), F.struct("*").alias("_row"),
    )
    pages = regions.groupBy("doc", "page").agg(F.array_sort(F.collect_list(facts)).alias("_regions"))

    def block(x: Column, n: Column, left: Column, numbers: Column) -> Column:
        return F.struct(n.alias("n"), left.alias("left"), x["_bottom"].alias("bottom"), x["_height"].alias("height"), x["_ends"].alias("ends"), x["_open"].alias("open"), numbers.alias("numbers"))

    def step(held: Column, x: Column) -> Column:
        gap = x["_top"] - held["bottom"]
        near = (F.abs(x["_f"] - held["left"]) <= x["_body"] * SAME_COLUMN) & (gap >= 0) & (gap <= held["height"] * GAP)
        goes_on = F.coalesce(held["open"] & x["_open"] & near & ~held["ends"] & ~x["_listed"], F.lit(False))
        n = F.when(goes_on, held["n"]).otherwise(held["n"] + 1)
        return block(x, n, F.when(goes_on, F.least(held["left"], x["_left"])).otherwise(x["_left"]), F.concat(held["numbers"], F.array(n)))

    none = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(c) for c in ("left", "bottom", "height")], F.lit(True).alias("ends"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("numbers"))
    numbered = pages.withColumn("_numbers", F.aggregate("_regions", none, step)["numbers"])
    rows = numbered.select(F.explode(F.arrays_zip(F.col("_regions"), F.col("_numbers"))).alias("x"))
    return rows.select(*[F.col("x._regions._row").getField(c).alias(c) for c in regions.columns], F.col("x._numbers").alias("paragraph"))


def paragraphs(regions: DataFrame, midword: bool = False) -> DataFrame:
    """(doc, page, paragraph, text, trailing_space): the lines of each paragraph rejoined, and whether the last one ends in a space."""
    line = F.struct(F.round("top", 1).alias("t"), "first_left", "order", "text", "trailing_space")
    grouped = continuations(regions).groupBy("doc", "page", "paragraph").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select("doc", "page", "paragraph", T.join_wrapped_lines(F.col("lines"), midword).alias("text"), F.coalesce(F.element_at("lines", -1)["trailing_space"], F.lit(False)).alias("trailing_space"))


def midword_evidence(lines: DataFrame) -> DataFrame:
    """Whether a document's trailing spaces tell word ends: at least 20 Hangul line ends, a fifth with a space."""
    ends = lines.where(~F.col("is_last") & F.rtrim("text").rlike(f"[{T.HANGUL}]$"))
    counted = ends.groupBy("doc").agg(F.count("*").alias("line_ends"), F.count_if("trailing_space").alias("with_space"))
    return counted.withColumn("midword", (F.col("line_ends") >= 20) & (F.col("with_space") / F.col("line_ends") >= 0.2))


def across_pages(found: DataFrame, midword: bool = False) -> DataFrame:
    """Paragraphs where a word split between two pages is whole again, on the first of them."""
    pages = Window.partitionBy("doc").orderBy("page", "paragraph")
    ends, opens = F.lead("page").over(pages) == F.col("page") + 1, F.lag("page").over(pages) == F.col("page") - 1
    mid = F.lit(midword)
    space = F.col("trailing_space") if "trailing_space" in found.columns else F.lit(False)
    space_before = F.lag("trailing_space").over(pages) if "trailing_space" in found.columns else F.lit(False)
    head = F.regexp_extract(F.lead("text").over(pages), r"^(\S+)", 1)
    own_head = F.regexp_extract(F.col("text"), r"^(\S+)", 1)
    gained = F.when(ends, T.join_across_break(F.col("text"), head, space, mid))
    lost = opens & T.join_across_break(F.lag("text").over(pages), own_head, space_before, mid).isNotNull()
    rest = F.regexp_replace(F.col("text"), r"^\S+\s*", "")
    return found.withColumn("text", F.when(F.coalesce(lost, F.lit(False)), rest).otherwise(F.coalesce(gained, F.col("text"))))
