import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmere.functions import text as T
from lexmere.operators import chunking, models
from lexmere.operators.access import Scope

PIECES = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def _signs():
    """A model that tells a text's length and first sign, and that must be loaded once a task."""
    calls = []

    def embed(texts):
        calls.append(len(texts))
        assert len(texts) <= 3
        return np.array([[len(t), ord(t[0]) if t else 0, 1.0] for t in texts])

    return embed


def test_vectors_in_slices(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else "x" * (k % 4), "own") for k in range(20)], "k int, text string, `a.b` string").repartition(2)
    got = {r.k: r for r in models.embedded(rows, _signs, 3, size=3).collect()}
    assert len(got) == 20 and got[0].embedding is None and got[1]["a.b"] == "own"
    for k, r in got.items():
        if k % 5:
            want = np.array([k % 4, 120 if k % 4 else 0, 1.0])
            assert np.allclose(r.embedding, want / np.linalg.norm(want), atol=1e-6)
    again = models.embedded(models.embedded(rows, _signs, 3, size=3), _signs, 3, size=3)
    assert again.columns == ["k", "text", "a.b", "embedding"] and again.where("embedding IS NULL").count() == 4
    assert models.embedded(rows.limit(0), _signs, 3).count() == 0


def test_vectors_of_another_size_are_an_error(spark):
    with pytest.raises(Exception, match="shape"):
        models.embedded(spark.createDataFrame([("x",)], "text string"), _signs, 4).collect()


def test_empty_question_is_an_error(spark):
    asked = spark.createDataFrame([("why?",)], "q string")
    assert asked.select(models.checked_question(F.col("q")).alias("q")).first().q == "why?"
    with pytest.raises(Exception, match="nothing to search for"):
        spark.createDataFrame([("  ",)], "q string").select(models.checked_question(F.col("q"))).collect()


TEXTS = ["", "one", "A sentence of words, and another.", "滤芯更换步骤说明", "필터 교체", "\U0001f600\U0001f600 ok", "x" * 500, "a  b\n\nc\t", "▁▁"]


def test_piece_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "k int, text string")
    got = {r.k: r.n for r in rows.select("k", models.piece_count(F.col("text"), PIECES).alias("n")).collect()}
    assert got == {**{k: len(model.encode(t)) for k, t in enumerate(TEXTS)}, 99: None}


@pytest.mark.parametrize("most", [1, 3, 7, 1000])
def test_pieces_split_whole(most):
    tokens = models.PieceTokens(PIECES)
    for t in TEXTS:
        parts = tokens.split(t, most)
        assert "".join(parts) == t and all(parts)
    assert len(tokens.split(TEXTS[2], 3)) > 1 and tokens.split("", 3) == []


def test_passages_with_a_models_tokens(spark):
    path = PIECES
    text = "The filter is changed once a year. Close the tap first. " * 60
    docs = spark.createDataFrame([("d", [(1, [("paragraph", text)])])], "document_id string, pages array<struct<page_number:int,blocks:array<struct<kind:string,text:string>>>>")
    made = chunking.chunk(docs, chunking.Budget(60, 90, 20, 10), lambda: models.PieceTokens(path)).orderBy("chunk_index").collect()
    tokens = models.PieceTokens(path)
    assert len(made) > 5 and all(r.token_count == tokens.count(r.text) and r.token_count <= 100 for r in made)


def test_models_are_replaced(spark):
    questions = spark.createDataFrame([(1, "What is a filter?"), (2, "Who?")], "ask_id long, question string")
    hits = spark.createDataFrame(
        [(1, "What is a filter?", 1, "d1", "A filter cleans water.", "me", "private"), (1, "What is a filter?", 2, "d2", "Filters hold back dirt.", "you", "private"), (2, "Who?", 1, "d3", "Nobody.", "you", "private")],
        "ask_id long, question string, rank int, document_id string, text string, owner_id string, visibility string",
    ).selectExpr("*", "concat(document_id, '.pdf') AS filename", "1 AS page_start", "1 AS page_end", "CAST(NULL AS STRING) AS heading")
    none = {r.ask_id: r for r in models.Models().answers(questions, hits).collect()}
    assert none[1].status == "unavailable" and none[1].n_sources == 2 and none[1].answer is None
    fake = models.Models(relevance=lambda q, t: F.when(t.contains("dirt"), 0.9).otherwise(0.2), answer=lambda message: F.regexp_extract(message, r"<source id=\"1\" file=\"([^\"]*)", 1))
    got = {r.ask_id: r for r in fake.answers(questions, hits).collect()}
    assert got[1].status == "generate" and got[1].answer == "d2.pdf" and got[1].language == "en"
    mine = {r.ask_id: r for r in fake.answers(questions, hits, Scope("me", "mine")).collect()}
    assert mine[1].answer == "d1.pdf" and mine[2].status == "not_found" and mine[2].answer is None
    blind = models.Models(may_see=lambda scope: F.lit(False))
    assert {r.status for r in blind.answers(questions, hits, Scope("me", "all")).collect()} == {"not_found"}
    failing = models.Models(relevance=lambda q, t: F.lit(None).cast("double"), answer=lambda message: F.regexp_extract(message, r"file=\"([^\"]*)", 1))
    assert {r.ask_id: r.answer for r in failing.answers(questions, hits).collect()}[1] == "d1.pdf"


def _rejoined(lines):
    """Lines joined one after the other, by the rules as they are stated."""
    out = ""
    for line in (x.strip() for x in lines):
        if not out or not line:
            out = out or line
            continue
        wide = rf"[{T.WIDE}]"
        if out.endswith("­"):
            out = out[:-1] + line
        elif re.search(r"[^\W_]-\S*[^\W_]-$", out) and re.match(r"[^\W_]", line):
            out += line
        elif re.search(r"[^\W\d_]-$", out) and line[0].islower():
            out = out[:-1] + line
        elif re.search(r"[^\W_]-$", out) and (line[0].isupper() or line[0].isdigit()):
            out += line
        elif (re.search(wide + "$", out) and re.match(wide, line)) or line[0] in ".,;:!?%)]}。，":
            out += line
        else:
            out += " " + line
    return out


def test_lines_of_any_length_join_as_one_by_one(spark):
    rng = random.Random(5)
    words = ["a", "re-", "Q-", "co-op-", "co-op", "x" * 45, "y-" + "z" * 60 + "-", "m" * 50 + "-", "soft­", "滤芯", "更" * 50, ", so", "9", "9-", "", "two words-", "b c d"]
    cases = [[rng.choice(words) for _ in range(rng.randrange(1, 14))] for _ in range(3000)]
    df = spark.createDataFrame([(k, [(x, False) for x in c]) for k, c in enumerate(cases)], "k int, l array<struct<text:string,trailing_space:boolean>>")
    got = {r.k: r.t for r in df.select("k", T.join_wrapped_lines(F.col("l")).alias("t")).collect()}
    bad = [(c, got[k], _rejoined(c)) for k, c in enumerate(cases) if got[k] != _rejoined(c)]
    assert not bad, bad[:3]


def test_counts_of_the_query_are_the_models(spark):
    import pandas as pd
    import sentencepiece

    from lexmere.plans.registry import QUERIES

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    want = {d: None if t is None else len(model.encode(t)) for d, t in zip(texts.doc_id, texts.text)}
    assert {r.doc_id: r.pieces for r in QUERIES["piece_counts"](spark, "/root/testdata/sf0.001").collect()} == want


def test_requests_of_a_table(spark):
    from lexmere.operators import access

    cases = [(" q ", 500), ("  ", 1), (None, 1), ("q", 0), ("q", None), ("x" * 2001, 3)]
    df = spark.createDataFrame(cases, "q string, k int").select(access.checked_search(F.col("q"), F.col("k")).alias("r")).select("r.*")
    got = [tuple(r) for r in df.collect()]
    assert got == [("q", 100, None), (None, None, "query"), (None, None, "query"), (None, None, "top_k"), ("q", 10, None), (None, None, "query")]
    for (q, k), (query, top_k, error) in zip(cases, got):
        if q is not None and error is None:
            assert access.check_search(q, k) == (query, top_k)
        elif q is not None:
            with pytest.raises(ValueError):
                access.check_search(q, k)


def test_a_report_is_what_was_judged(spark, tmp_path):
    import json

    from lexmere.operators import evaluation
    from lexmere.plans import retrieval

    results, path = retrieval._answers(spark, "/root/testdata/sf0.001"), f"file://{tmp_path}/report"
    evaluation.write_report(results, path)
    cases, summary = evaluation.read_report(results, path)
    assert cases.exceptAll(results).count() == 0 and cases.count() == results.count()
    assert summary.collect() == evaluation.answer_summary(results).collect()
    lines = [json.loads(x) for f in (tmp_path / "report/cases").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == cases.count() and all(set(x) == set(results.columns) for x in lines)
    with pytest.raises(Exception, match="(?i)exists"):
        evaluation.write_report(results, path)
    empty = results.limit(0)
    evaluation.write_report(empty, path + "2")
    assert [x.count() for x in evaluation.read_report(empty, path + "2")] == [0, 1]
