"""Retrieval and answer evaluation: ranks, recall, reciprocal ranks, shares, separability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cited_numbers, holds_facts, is_in_language


def first_ranks(cases: DataFrame, hits: DataFrame, k: int, case: str = "case_id") -> DataFrame:
    """Each case's first matching rank within k; hits carry `matches`. No match gives null."""
    found = hits.where((F.col("rank") <= k) & F.col("matches")).groupBy(case).agg(F.min("rank").alias("first_rank"))
    return cases.join(found, case, "left")


def expected_page(filename: str = "filename", page: str = "page", start: str = "page_start", end: str = "page_end", name: str = "expect_filename"):
    """The right file, and the expected page within the passage's pages."""
    return (F.col(filename) == F.col(name)) & F.col(page).between(F.col(start), F.col(end))


def summary(ranks: DataFrame, group: str | None = None, took: str | None = None) -> DataFrame:
    """recall at 1 and k, mean reciprocal rank and, where cases tell it, median time; overall and, with a group, for each."""
    measures = [
        F.count("*").alias("cases"),
        F.round(F.coalesce(F.avg(F.when(F.col("first_rank") == 1, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("recall_at_1"),
        F.round(F.coalesce(F.avg(F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("recall_at_k"),
        F.round(F.coalesce(F.avg(F.when(F.col("first_rank").isNotNull(), 1 / F.col("first_rank")).otherwise(0.0)), F.lit(0.0)), 6).alias("mrr"),
    ]
    if took is not None:
        measures.append(F.median(took).alias("median_ms"))
    if group is None:
        return ranks.agg(*measures)
    return ranks.groupingSets([[], [F.col(group)]], F.col(group)).agg(*measures)


def best_preset(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.max_by("preset", F.struct("mrr", "recall_at_1")).alias("preset"))


def scored_answers(answers: DataFrame) -> DataFrame:
    """Answers judged: needs answer, language, facts, forbid, status, source_rank, n_sources, expected (array of source numbers), unanswerable."""
    cited = cited_numbers(F.col("answer"))
    judged = answers.withColumns(
        {
            "cited": cited,
            "cites_expected": F.exists(cited, lambda n: F.array_contains("expected", n)),
            "citations_valid": F.forall(cited, lambda n: n.between(1, F.col("n_sources"))),
            "language_ok": is_in_language(F.col("answer"), F.col("language")),
            "facts_ok": holds_facts(F.col("answer"), F.col("facts")),
            "abstained": (F.col("status") != "error") & ((F.col("status") == "not_found") | (F.size(cited) == 0)) & ~F.exists("forbid", lambda w: F.col("answer").contains(w)),
        }
    )
    passed = F.when(F.col("unanswerable"), F.col("abstained") & F.col("language_ok")).otherwise(F.col("source_rank").isNotNull() & F.col("facts_ok") & F.col("language_ok") & F.col("cites_expected") & F.col("citations_valid"))
    return judged.withColumn("passed", passed)


def answer_summary(results: DataFrame) -> DataFrame:
    """Shares over all, answerable and unanswerable cases."""

    def share(test, among=None):
        hit = F.when(test, 1.0).otherwise(0.0)
        return F.round(F.coalesce(F.avg(hit if among is None else F.when(among, hit)), F.lit(0.0)), 6)

    answerable = ~F.col("unanswerable")
    return results.agg(
        share(F.col("passed")).alias("passed"),
        share(F.col("source_rank").isNotNull(), answerable).alias("retrieved"),
        share(F.col("facts_ok"), answerable).alias("facts"),
        share(F.col("cites_expected") & F.col("citations_valid"), answerable).alias("cites_expected"),
        share(F.col("language_ok")).alias("language"),
        share(F.col("abstained"), F.col("unanswerable")).alias("abstained_correctly"),
        share(~F.col("abstained"), answerable).alias("answered_when_it_should"),
    )


def separability(results: DataFrame, score: str = "top_relevance") -> DataFrame:
    """The least answerable and the greatest unanswerable score, and whether a threshold splits them."""
    a, u = F.when(~F.col("unanswerable"), F.col(score)), F.when(F.col("unanswerable"), F.col(score))
    out = results.agg(F.min(a).alias("answerable_min"), F.median(a).alias("answerable_median"), F.max(u).alias("unanswerable_max"), F.median(u).alias("unanswerable_median"))
    return out.withColumn("separable", F.col("unanswerable_max") < F.col("answerable_min"))


def write_report(results: DataFrame, path: str) -> None:
    """An evaluation as JSON under a new path: `cases`, a line for each, written by the tasks that judged them, and `summary`, one line.

    The summary is taken of the cases that were written. Nulls stay as fields; a report that is there is an error.
    """
    where = path.rstrip("/")
    results.write.option("ignoreNullFields", "false").json(f"{where}/cases")
    cases = results.sparkSession.read.schema(results.schema).json(f"{where}/cases")
    answer_summary(cases).coalesce(1).write.option("ignoreNullFields", "false").json(f"{where}/summary")


def read_report(results: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, summary) of a report of results with these columns."""
    where = path.rstrip("/")
    read = results.sparkSession.read
    return read.schema(results.schema).json(f"{where}/cases"), read.schema(answer_summary(results).schema).json(f"{where}/summary")
