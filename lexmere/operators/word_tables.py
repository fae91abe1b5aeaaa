"""Tables of a page from the boxes of its words: rows, columns and cells by interval union, as Markdown.

Words come from any parser as (doc, page, text, left, top, right, bottom). Words whose
heights overlap, directly or through others, are a row; rows close below each other are a
block; within a block, words whose widths overlap or nearly touch are a column. A block of
at least two rows and two columns, whose every row but headings fills two cells, is a table.
All windows lie within a page, which holds a bounded number of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import table_markdown
from .layout import overlaps_of

#: a gap between columns, and between the rows of a block as a share of a row's height
COLUMN_GAP, ROW_GAP = 6.0, 1.5


def _islands(words: DataFrame, within: list[str], start: str, end: str, gap: Column, name: str) -> DataFrame:
    """Numbers, from 1, the unions of the intervals [start, end], joined over gaps up to `gap`."""
    order = Window.partitionBy(*within).orderBy(start, end, "left", "top", "text")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = words.withColumn("_fresh", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    return marked.withColumn(name, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fresh")


def cells(words: DataFrame, column_gap: float = COLUMN_GAP, row_gap: float = ROW_GAP) -> DataFrame:
    """Words with their row (of the page), block and column (of the block)."""
    usable = words.where("text IS NOT NULL AND trim(text) <> '' AND right > left AND bottom > top")
    rows = _islands(usable, ["doc", "page"], "top", "bottom", F.lit(0.0), "row")
    spans = rows.groupBy("doc", "page", "row").agg(F.min("top").alias("_top"), F.max("bottom").alias("_bottom"))
    order = Window.partitionBy("doc", "page").orderBy("row")
    before = F.lag(F.struct("_top", "_bottom")).over(order)
    far = before.isNull() | (F.col("_top") - before["_bottom"] > row_gap * (before["_bottom"] - before["_top"]))
    blocks = spans.withColumn("_far", far.cast("int")).withColumn("block", F.sum("_far").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).select("doc", "page", "row", "block")
    return _islands(rows.join(blocks, ["doc", "page", "row"]), ["doc", "page", "block"], "left", "right", F.lit(column_gap), "column")


def tables(words: DataFrame, column_gap: float = COLUMN_GAP, row_gap: float = ROW_GAP) -> DataFrame:
    """(doc, page, block, n_rows, n_columns, left, top, right, bottom, markdown), a row for each table."""
    found = cells(words, column_gap, row_gap)
    word = F.struct("left", "top", "text")
    cell = found.groupBy("doc", "page", "block", "row", "column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: F.trim(w["text"])), " ").alias("text"), *[f(c).alias(c) for c, f in (("left", F.min), ("top", F.min), ("right", F.max), ("bottom", F.max))]
    )
    width = F.max("column").over(Window.partitionBy("doc", "page", "block"))
    line = cell.withColumn("n_columns", width).groupBy("doc", "page", "block", "row").agg(F.first("n_columns").alias("n_columns"), F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("by_column"), *[f(c).alias(c) for c, f in (("left", F.min), ("top", F.min), ("right", F.max), ("bottom", F.max))])
    filled = F.transform(F.sequence(F.lit(1), F.col("n_columns")), lambda k: F.coalesce(F.try_element_at("by_column", k), F.lit("")))
    lines = line.select("doc", "page", "block", "row", "n_columns", F.size("by_column").alias("n"), filled.alias("cells"), "left", "top", "right", "bottom")
    block = lines.groupBy("doc", "page", "block").agg(
        F.count("*").alias("n_rows"), F.first("n_columns").alias("n_columns"), F.count_if(F.col("n") >= 2).alias("_full"),
        F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("_cells"), *[f(c).alias(c) for c, f in (("left", F.min), ("top", F.min), ("right", F.max), ("bottom", F.max))],
    )
    kept = block.where((F.col("n_rows") >= 2) & (F.col("n_columns") >= 2) & (F.col("_full") >= 2) & (2 * F.col("_full") > F.col("n_rows")))
    return kept.select("doc", "page", "block", "n_rows", "n_columns", "left", "top", "right", "bottom", table_markdown(F.col("_cells")).alias("markdown"))


def outside(regions: DataFrame, found: DataFrame) -> DataFrame:
    """Regions (doc, page, left, top, right, bottom, ...) that do not lie by more than half in a table of their page."""
    box = lambda: F.struct("left", "top", "right", "bottom")
    of_page = found.groupBy("doc", "page").agg(F.collect_list(box()).alias("_tables"))
    # few tables a page: a region is held against each in its own row
    shared = lambda t: overlaps_of(F.struct("left", "top", "right", "bottom"), t)
    kept = regions.join(of_page, ["doc", "page"], "left").where(~F.coalesce(F.exists("_tables", shared), F.lit(False)))
    return kept.select(*regions.columns)
