"""Vector search, question answering and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import access, evaluation, rag, search
from ..operators.access import Scope
from ..sources import shared
from . import derived as d
from .catalog import query, table
from .textual import question_sql

_COLUMNS = ("query_id", "rank", "vec_id", "document_id", "chunk_index", "score")


def _every(spark, sf, which="vec_id % 50 = 0"):
    return table(spark, sf, "embeddings").where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _topk_sql(where: str, k: int = 10, which: str = "q.vec_id % 50 = 0") -> str:
    dot = d.DOT.format(a="p.embedding", b="q.embedding")
    return (
        d.with_(d.PASSAGES)
        + f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, document_id, chunk_index, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM (
        SELECT q.vec_id AS query_id, p.vec_id, p.document_id, p.chunk_index, {dot} AS score FROM passages p, embeddings q
        WHERE {which} AND p.kind IS DISTINCT FROM 'heading' AND {where})) WHERE rank <= {k}"""
    )


# the queries of the searches: every row whose id is divisible by 50
@query(_topk_sql("true"))
def vector_batch_topk(spark, sf):
    return search.vector_topk(d.passages(spark, sf), _every(spark, sf), 10).select(*_COLUMNS)


@query(_topk_sql("p.language = 'en'"))
def vector_topk_filtered(spark, sf):
    return search.vector_topk(d.passages(spark, sf), _every(spark, sf), 10, {"language": "en"}).select(*_COLUMNS)


@query(_topk_sql("(p.owner_id = 'src1' OR p.visibility = 'public')"))
def vector_topk_scoped(spark, sf):
    return search.vector_topk(d.passages(spark, sf), _every(spark, sf), 10, scope=Scope("src1")).select(*_COLUMNS)


@query(_topk_sql("true", 10, "q.vec_id = 0").replace("SELECT query_id, CAST(rank AS INTEGER) AS rank, ", "SELECT ", 1))
def vector_topk(spark, sf):
    vector = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    return search.single_topk(d.passages(spark, sf), vector, 10).select("vec_id", "document_id", "chunk_index", "score")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, round(sqrt(list_sum(list_transform(embedding, lambda x: power(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 2)))), 4) AS after FROM embeddings")
def vector_norms(spark, sf):
    def norm(c):
        return F.round(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4)

    return table(spark, sf, "embeddings").select("vec_id", norm(F.col("embedding")).alias("norm"), norm(ids.normalised(F.col("embedding"))).alias("after"))


_SCORE = "round(CAST(len(list_filter(string_split(question, ''), lambda c: contains(text, c))) AS DOUBLE) / length(question), 6)"
_KEY = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_RERANKED = (
    d.with_(d.QUESTIONS, d.HITS)
    + f""", once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY ask_id, {_KEY} ORDER BY rank) = 1),
    few AS (SELECT *, {_SCORE} AS rerank FROM (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY rank) <= 6)),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY ask_id ORDER BY rerank DESC, rank) AS INTEGER) AS place FROM few)\n"""
)


def _reranked(spark, sf):
    return rag.rerank(d.hits(spark, sf), 6)


@query(_RERANKED + "SELECT ask_id, place, document_id, rerank FROM ranked")
def rerank_topn(spark, sf):
    return _reranked(spark, sf).select("ask_id", "place", "document_id", "rerank")


#: questions in several scripts, each with letters, so that no passage decides
_SPOKEN_ASKED = d.spoken("question", "(ask_id % 7)")
_PACKED = (
    _RERANKED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, items AS (SELECT ask_id, place, length(text) // 3 + 1 + 40 AS cost FROM ranked WHERE rerank >= 0.5), ordered AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY place) AS i FROM items),
    fold AS (SELECT ask_id, i, place, cost, cost AS used, 1 AS n, true AS kept FROM ordered WHERE i = 1
        UNION ALL SELECT o.ask_id, o.i, o.place, o.cost, CASE WHEN f.n < 3 AND f.used + o.cost <= 260 THEN f.used + o.cost ELSE f.used END,
            CASE WHEN f.n < 3 AND f.used + o.cost <= 260 THEN f.n + 1 ELSE f.n END, f.n < 3 AND f.used + o.cost <= 260
        FROM fold f JOIN ordered o ON o.ask_id = f.ask_id AND o.i = f.i + 1),
    sources AS (SELECT f.ask_id, CAST(f.n AS INTEGER) AS n, f.place, CAST(f.cost AS INTEGER) AS cost, r.document_id, r.text, r.filename, r.rerank FROM fold f JOIN ranked r ON r.ask_id = f.ask_id AND r.place = f.place WHERE f.kept)\n"""
)


def _sources(spark, sf):
    return rag.source_rows(rag.relevant(_reranked(spark, sf), 0.5), 3, 260)


@query(_PACKED + "SELECT ask_id, n, place, cost, document_id FROM sources")
def pack_sources(spark, sf):
    return _sources(spark, sf).select("ask_id", "n", "place", "cost", "document_id")


@query(_PACKED + "SELECT q.ask_id, CAST(count(s.n) AS BIGINT) AS n_sources, CASE WHEN count(s.n) = 0 THEN 'not_found' ELSE 'generate' END AS status, CASE WHEN f IS NULL OR f = 'other' THEN 'en' ELSE f END AS language FROM (SELECT ask_id, " + question_sql("asked") + " AS f FROM (SELECT ask_id, " + _SPOKEN_ASKED + " AS asked FROM questions)) q LEFT JOIN sources s ON s.ask_id = q.ask_id GROUP BY q.ask_id, f")
def answer_status(spark, sf):
    asked = d.questions(spark, sf).withColumn("question", F.expr(_SPOKEN_ASKED))
    return rag.answer_states(asked, _sources(spark, sf), True).select("ask_id", F.col("n_sources").cast("long").alias("n_sources"), "status", "language")


@query(
    _PACKED
    + """SELECT q.ask_id, '<sources>' || chr(10) || string_agg('<source id="' || n || '" file="' || filename || '" pages="~1-2">' || chr(10) || trim(text) || chr(10) || '</source>', chr(10) || chr(10) ORDER BY n)
        || chr(10) || '</sources>' || chr(10) || chr(10) || 'Question: ' || trim(q.question) || chr(10) || chr(10) || 'Answer in English.' AS message
    FROM questions q JOIN sources s ON s.ask_id = q.ask_id GROUP BY q.ask_id, q.question"""
)
def prompt_messages(spark, sf):
    asked = d.questions(spark, sf).withColumn("language", F.lit("en"))
    return rag.prompts(asked, _sources(spark, sf))


_FIRST = (
    "WITH top AS (" + _topk_sql("true", 5, "true") + """), firsts AS (SELECT e.vec_id AS case_id, e.label % 2 AS "group", e.vec_id % 97 AS took, min(t.rank) FILTER (WHERE t.document_id = CAST(e.label AS VARCHAR) AND t.vec_id <> e.vec_id) AS first_rank
    FROM embeddings e LEFT JOIN top t ON t.query_id = e.vec_id GROUP BY e.vec_id, e.label)\n"""
)
_MEASURES = """count(*) AS cases, round(coalesce(avg(CASE WHEN first_rank = 1 THEN 1.0 ELSE 0.0 END), 0.0), 6) AS recall_at_1,
    round(coalesce(avg(CASE WHEN first_rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0), 6) AS recall_at_k, round(coalesce(avg(CASE WHEN first_rank IS NOT NULL THEN 1.0 / first_rank ELSE 0.0 END), 0.0), 6) AS mrr, CAST(median(took) AS DOUBLE) AS median_ms"""


def _ranks(spark, sf):
    cases = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), (F.col("label") % 2).alias("group"), F.col("label").cast("string").alias("wanted"), (F.col("vec_id") % 97).alias("took"))
    hits = search.vector_topk(d.passages(spark, sf), _every(spark, sf, "true"), 5).withColumnRenamed("query_id", "case_id")
    judged = hits.join(cases, "case_id").withColumn("matches", (F.col("document_id") == F.col("wanted")) & (F.col("vec_id") != F.col("case_id")))
    return evaluation.first_ranks(cases, judged, 5)


@query(_FIRST + f"SELECT {_MEASURES} FROM firsts")
def retrieval_metrics(spark, sf):
    return evaluation.summary(_ranks(spark, sf), took="took")


@query(_FIRST + f'SELECT "group", {_MEASURES} FROM firsts GROUP BY GROUPING SETS ((), ("group"))')
def retrieval_metrics_grouped(spark, sf):
    return evaluation.summary(_ranks(spark, sf), "group", "took")


@query(_FIRST + "SELECT case_id, first_rank FROM firsts")
def first_match_rank(spark, sf):
    return _ranks(spark, sf).select("case_id", "first_rank")


@query(
    d.with_(d.PASSAGES)
    + """, o AS (SELECT filename, CAST(vec_id % 10 + 1 AS INTEGER) AS page, min(vec_id) AS expected FROM passages GROUP BY filename, page)
    SELECT p.vec_id, o.expected FROM passages p JOIN o ON p.filename = o.filename AND o.page BETWEEN p.page_start AND p.page_end"""
)
def expected_pages(spark, sf):
    """An expectation is a page of a file; a passage meets at most those of the pages it stands on."""
    p = d.passages(spark, sf).select("vec_id", "filename", "page_start", "page_end")
    wanted = p.groupBy(F.col("filename").alias("expect_filename"), (F.col("vec_id") % 10 + 1).cast("int").alias("page")).agg(F.min("vec_id").alias("expected"))
    return p.join(wanted, evaluation.expected_page()).select("vec_id", "expected")


@query("SELECT CAST(user_id % 3 AS BIGINT) AS preset, round(avg(value), 6) AS mrr FROM events GROUP BY preset ORDER BY mrr DESC, preset DESC LIMIT 1")
def best_preset(spark, sf):
    s = table(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("preset")).agg(F.round(F.avg("value"), 6).alias("mrr")).withColumn("recall_at_1", F.col("preset"))
    return evaluation.best_preset(s).join(s, "preset").select("preset", "mrr")


_ANSWERS = """answers AS (SELECT item_id, item_id % 4 = 0 AS unanswerable, CASE WHEN item_id % 8 = 0 THEN 'not_found' ELSE 'done' END AS status,
    CASE WHEN item_id % 8 = 0 THEN text ELSE text || ' [' || (item_id % 3 + 1) || ']' END AS answer, CASE WHEN item_id % 5 <> 0 THEN 1 END AS source_rank,
    item_id % 3 + 1 AS c, item_id % 8 <> 0 AS cites, item_id % 7 <> 0 AS facts_ok, item_id % 9 <> 0 AS language_ok, length(text) AS relevance FROM benchmark)"""


def _answers(spark, sf):
    n = F.col("item_id")
    b = table(spark, sf, "benchmark").select(
        "item_id", (n % 4 == 0).alias("unanswerable"), F.when(n % 8 == 0, "not_found").otherwise("done").alias("status"), F.when(n % 9 == 0, "ko").otherwise("en").alias("language"),
        F.when(n % 8 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" ["), (n % 3 + 1).cast("string"), F.lit("]"))).alias("answer"),
        F.when(n % 5 != 0, 1).alias("source_rank"), F.lit(2).alias("n_sources"), F.array(F.lit(1), F.lit(2)).alias("expected"),
        F.when(n % 7 == 0, F.array(F.lit("qqqq"))).otherwise(F.array(F.substring_index("text", " ", 2))).alias("facts"), F.array(F.lit("zzzz")).alias("forbid"), F.length("text").cast("long").alias("relevance"),
    )
    return evaluation.scored_answers(b)


_PASSED = "CASE WHEN unanswerable THEN NOT cites AND language_ok ELSE source_rank IS NOT NULL AND facts_ok AND language_ok AND cites AND c <= 2 END"


@query(d.with_(_ANSWERS) + f"SELECT item_id, CASE WHEN cites THEN CAST(c AS VARCHAR) ELSE '' END AS cited, NOT cites AS abstained, {_PASSED} AS passed FROM answers")
def answer_scores(spark, sf):
    return _answers(spark, sf).select("item_id", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), "abstained", "passed")


@query(
    d.with_(_ANSWERS)
    + f"""SELECT round(avg(CASE WHEN {_PASSED} THEN 1.0 ELSE 0.0 END), 6) AS passed, round(avg(CASE WHEN source_rank IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT unanswerable), 6) AS retrieved,
    round(avg(CASE WHEN facts_ok THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT unanswerable), 6) AS facts, round(avg(CASE WHEN cites AND c <= 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT unanswerable), 6) AS cites_expected, round(avg(CASE WHEN language_ok THEN 1.0 ELSE 0.0 END), 6) AS language,
    round(avg(CASE WHEN NOT cites THEN 1.0 ELSE 0.0 END) FILTER (WHERE unanswerable), 6) AS abstained_correctly, round(avg(CASE WHEN cites THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT unanswerable), 6) AS answered_when_it_should FROM answers"""
)
def answer_eval(spark, sf):
    return evaluation.answer_summary(_answers(spark, sf))


@query(
    d.with_(_ANSWERS)
    + """SELECT min(relevance) FILTER (WHERE NOT unanswerable) AS answerable_min, median(relevance) FILTER (WHERE NOT unanswerable) AS answerable_median, max(relevance) FILTER (WHERE unanswerable) AS unanswerable_max,
    median(relevance) FILTER (WHERE unanswerable) AS unanswerable_median, max(relevance) FILTER (WHERE unanswerable) < min(relevance) FILTER (WHERE NOT unanswerable) AS separable FROM answers"""
)
def threshold_separability(spark, sf):
    return evaluation.separability(_answers(spark, sf), "relevance")


@query(d.with_(d.QUESTIONS, d.HITS) + f"SELECT ask_id, document_id, rank FROM hits QUALIFY row_number() OVER (PARTITION BY ask_id, {_KEY} ORDER BY rank) = 1")
def distinct_hits(spark, sf):
    return rag.distinct_hits(d.hits(spark, sf)).select("ask_id", "document_id", F.col("rank").cast("long").alias("rank"))


_ASKED = d.spoken("question", "ask_id")


@query(
    d.with_(d.QUESTIONS)
    + f"""SELECT ask_id, CASE WHEN found IS NULL OR found = 'other' THEN 'en' ELSE found END AS language, coalesce(found = 'other', false) AS unsupported
    FROM (SELECT ask_id, coalesce({question_sql("q")}, CASE WHEN top <> '' THEN {question_sql("top")} END) AS found FROM (SELECT ask_id, {_ASKED} AS q, CASE WHEN ask_id % 3 = 0 THEN '' ELSE '필터를 바꿉니다' END AS top FROM questions))"""
)
def answer_language(spark, sf):
    asked = d.questions(spark, sf).select("ask_id", F.expr(_ASKED).alias("q"), F.expr("CASE WHEN ask_id % 3 = 0 THEN '' ELSE '필터를 바꿉니다' END").alias("top"))
    chosen = text.choose_language(F.col("q"), F.col("top"))
    return asked.select("ask_id", chosen["language"].alias("language"), chosen["unsupported"].alias("unsupported"))


@query(d.with_(d.PASSAGES) + "SELECT document_id, sum_tokens, pages FROM (SELECT document_id, CAST(sum(token_count) AS BIGINT) AS sum_tokens FROM passages GROUP BY document_id) JOIN (SELECT document_id, count(DISTINCT p) AS pages FROM (SELECT document_id, unnest(range(page_start, page_end + 1)) AS p FROM passages) GROUP BY document_id) USING (document_id)")
def passage_pages_covered(spark, sf):
    p = d.passages(spark, sf)
    tokens = p.groupBy("document_id").agg(F.sum("token_count").alias("sum_tokens"))
    pages = p.select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("p")).groupBy("document_id").agg(F.countDistinct("p").alias("pages"))
    return tokens.join(pages, "document_id")


@query(d.with_(d.PASSAGES) + "SELECT vec_id, chunk_index, lag(vec_id) OVER w AS previous, row_number() OVER (PARTITION BY document_id, page_start ORDER BY chunk_index) = 1 AS opens_page, count(*) OVER (PARTITION BY document_id, page_start) AS page_rows FROM passages WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)")
def passage_windows(spark, sf):
    own, page = Window.partitionBy("document_id").orderBy("chunk_index"), Window.partitionBy("document_id", "page_start")
    return d.passages(spark, sf).select("vec_id", "chunk_index", F.lag("vec_id").over(own).alias("previous"), (F.row_number().over(page.orderBy("chunk_index")) == 1).alias("opens_page"), F.count("*").over(page).alias("page_rows"))


@query(d.with_(d.PASSAGES) + "SELECT vec_id, last_value(CASE WHEN kind = 'heading' THEN vec_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index) AS heading FROM passages")
def heading_fill(spark, sf):
    own = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return d.passages(spark, sf).select("vec_id", F.last(F.when(F.col("kind") == "heading", F.col("vec_id")), True).over(own).alias("heading"))


@query(
    d.with_(_ANSWERS)
    + f"""SELECT item_id, cites AS cited, CASE WHEN {_PASSED} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS passed FROM answers
    UNION ALL SELECT NULL, NULL, round(avg(CASE WHEN {_PASSED} THEN 1.0 ELSE 0.0 END), 6) FROM answers"""
)
def eval_report(spark, sf):
    """A report written and read again: its cases, and a row of the summary's share."""
    results, path = _answers(spark, sf), shared.fresh(spark, "report")
    evaluation.write_report(results, path)
    cases, summary = evaluation.read_report(results, path)
    shares = cases.select("item_id", (F.size("cited") > 0).alias("cited"), F.col("passed").cast("double").alias("passed"))
    return shares.unionByName(summary.select("passed"), allowMissingColumns=True)
