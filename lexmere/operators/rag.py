"""Question answering as batch tables: rerank, threshold, source packing, language, status, prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import overlap_score
from ..functions.text import choose_language, estimate_tokens, page_label, passage_key, source_block

TAG_TOKENS = 40
LANGUAGE_NAMES = {"en": "English", "ko": "Korean", "zh-Hans": "Simplified Chinese", "zh-Hant": "Traditional Chinese"}


def distinct_hits(hits: DataFrame, key: str = "ask_id") -> DataFrame:
    """The first of hits with equal text, by search rank; texts are told apart by their digests, so that a sort holds no second copy of them."""
    order = Window.partitionBy(key, "_text").orderBy("rank")
    return hits.withColumn("_text", F.unhex(F.sha2(passage_key(F.col("text")), 256))).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_text")


def rerank(hits: DataFrame, candidates: int, score: Column | None = None, key: str = "ask_id") -> DataFrame:
    """The first distinct hits scored against their question and ordered by score, ties by search rank."""
    order = Window.partitionBy(key).orderBy("rank")
    first = distinct_hits(hits, key).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= candidates).drop("_n")
    scored = first.withColumn("rerank", F.round(score if score is not None else overlap_score(F.col("question"), F.col("text")), 6))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rerank"), "rank")))


def relevant(hits: DataFrame, least: float) -> DataFrame:
    """Hits whose rerank score reaches the threshold; a missing score passes."""
    return hits.where(F.col("rerank").isNull() | (F.col("rerank") >= least))


SOURCE = "array<struct<n:int,place:int,cost:int>>"


def pack_sources(hits: DataFrame, most: int, budget: int, key: str = "ask_id") -> DataFrame:
    """One row a question: its numbered sources, best first, without repeats and within the token budget.

    A passage that would overflow is skipped, not cut, and later ones still count; the
    first is always kept. An ordered fold over the question's few hits.
    """
    cost = estimate_tokens(F.col("text")) + TAG_TOKENS
    item = F.struct(F.col("place").cast("int").alias("place"), passage_key(F.col("text")).alias("key"), cost.alias("cost"))
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast(SOURCE).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["kept"])
        fits = (n < most) & (x["key"] != "") & ~F.array_contains(acc["seen"], x["key"]) & ((n == 0) | (acc["used"] + x["cost"] <= budget))
        added = F.struct((n + 1).alias("n"), x["place"].alias("place"), x["cost"].alias("cost"))
        return F.struct(
            F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["seen"], F.array(x["key"]))).otherwise(acc["seen"]).alias("seen"),
            F.when(fits, F.concat(acc["kept"], F.array(added))).otherwise(acc["kept"]).alias("kept"),
        )

    return listed.select(key, F.aggregate("items", start, step, lambda a: a["kept"]).alias("sources"))


def source_rows(hits: DataFrame, most: int, budget: int, key: str = "ask_id") -> DataFrame:
    """The packed sources as rows, with their hits' columns."""
    packed = pack_sources(hits, most, budget, key).select(key, F.explode("sources").alias("s")).select(key, "s.n", "s.place", "s.cost")
    return packed.join(hits, [key, "place"])


def answer_states(questions: DataFrame, sources: DataFrame, model_available: bool, key: str = "ask_id") -> DataFrame:
    """not_found without sources, unavailable without a model, else generate; and the answer's language."""
    top = sources.where("n = 1").select(key, F.col("text").alias("_top"))
    counts = sources.groupBy(key).agg(F.count("*").alias("n_sources"), F.max("rerank").alias("top_relevance"))
    joined = questions.join(counts, key, "left").join(top, key, "left")
    language = choose_language(F.col("question"), F.col("_top"))
    status = F.when(F.col("n_sources").isNull(), "not_found").otherwise("generate" if model_available else "unavailable")
    return joined.select(key, F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "top_relevance", status.alias("status"), language["language"].alias("language"), language["unsupported"].alias("unsupported"))


def prompts(questions: DataFrame, sources: DataFrame, key: str = "ask_id") -> DataFrame:
    """The user message of each question: its sources, the question, the language."""
    label = page_label(F.col("filename"), F.col("page_start"), F.col("page_end"))
    block = F.struct("n", source_block(F.col("n"), F.col("filename"), label, F.col("heading"), F.col("text")).alias("block"))
    blocks = sources.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["block"]), "\n\n").alias("blocks"))
    names = F.create_map(*[F.lit(v) for pair in LANGUAGE_NAMES.items() for v in pair])
    return questions.join(blocks, key).select(
        key, F.concat(F.lit("<sources>\n"), "blocks", F.lit("\n</sources>\n\nQuestion: "), F.trim("question"), F.lit("\n\nAnswer in "), F.element_at(names, F.col("language")), F.lit(".")).alias("message")
    )


def event_text(name: Column, payload: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), payload, F.lit("\n\n"))


def delta_text(line: Column) -> Column:
    """The text in a line of a token stream; null for other, final and broken lines."""
    data = F.trim(F.substring(line, F.lit(6), F.length(line)))
    return F.when(F.startswith(line, F.lit("data:")) & (data != "[DONE]"), F.get_json_object(data, "$.choices[0].delta.content"))


def event_blocks(stream: Column) -> Column:
    """A stream's text as an array of events (event, data); comments and empty blocks are left out."""
    blocks = F.split(F.regexp_replace(stream, r"\r\n?", "\n"), r"\n\n+")

    def values(block: Column, field: str) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: F.startswith(x, F.lit(field + ":")))
        return F.transform(lines, lambda x: F.regexp_replace(F.substring(x, F.lit(len(field) + 2), F.length(x)), "^ ", ""))

    parsed = F.transform(blocks, lambda b: F.struct(F.coalesce(F.try_element_at(values(b, "event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(values(b, "data"), "\n").alias("data")))
    return F.filter(parsed, lambda e: e["data"] != "")


def rerank_or_search(hits: DataFrame, candidates: int, score: Column | None = None, key: str = "ask_id") -> DataFrame:
    """rerank(), but a question of which any hit has no score (the reranker failed) keeps the search's order, without scores."""
    found = rerank(hits, candidates, score, key).drop("place")
    broken = F.max(F.col("rerank").isNull()).over(Window.partitionBy(key))
    safe = found.withColumn("_broken", broken).withColumn("rerank", F.when(~F.col("_broken"), F.col("rerank"))).drop("_broken")
    return safe.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("rerank"), "rank")))
