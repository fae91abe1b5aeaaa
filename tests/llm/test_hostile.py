"""Inputs made to hurt: runs that rules could read again and again, one id for many rows, blocks of items, many small messages."""

import time

import numpy as np
import pytest

from lexmere.llm import decontaminate, jaccard_join, language, packing, scratch, secrets_scan, topk
from lexmere.llm.html_text import main_text

PARAGRAPH = "This is a whole paragraph of the article, with commas, and with enough words to be one, as it goes on and on for a while longer. "
RUNS = ["eyJ", "eyJa.", "eyJeyJ.eyJ.", "-----BEGIN PRIVATE ", "-----BEGIN ", "ghp_a", "xoxb-", "AIzaAIza", "sk_live_", "http://a:", "a://", "AKIA", "password ", "token='", "deadbeef ", "0123456789abcde "]


def test_secret_rules_read_a_run_once(spark):
    docs = spark.createDataFrame([(k, run * (400_000 // len(run))) for k, run in enumerate(RUNS)], "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    secrets_scan.digest(secrets_scan.scan(docs)).collect()
    assert time.perf_counter() - began < 60  # a rule that reads a run again from each place takes hours


def test_web_tokens_are_found(spark):
    token = "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl_-x"
    texts = [f"Bearer {token}", f"a={token};", "eyJa.eyJb", f"x{token}", f"{token}.{token}"]
    got = {r.doc_id: r.spans for r in secrets_scan.digest(secrets_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got == {0: f"web_token:7:{7 + len(token)}", 1: f"web_token:2:{2 + len(token)}", 2: "", 3: "", 4: f"web_token:0:{len(token)},web_token:{len(token) + 1}:{2 * len(token) + 1}"}
    assert secrets_scan.trigram_query([r for r in secrets_scan.MORE if r.kind == "web_token"][0].pattern) == [[".ey", "eyj"]]


def test_language_sample_is_bounded_by_rank(spark, monkeypatch):
    monkeypatch.setattr(language, "WINDOWS", 60)
    chosen = spark.range(5000).orderBy(language.F.expr("pmod(xxhash64(id), 1 << 30)")).first()[0]
    rows = [(chosen, f"the same identity with text number {k}", "en") for k in range(800)] + [(k, f"ein anderer Text mit der Nummer {k}", "de") for k in range(10_000, 10_060)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sizes = []
    monkeypatch.setattr(language.Network, "fit", lambda self, x, y: sizes.append(np.bincount(y).tolist()) or self)
    assert language.train(docs) is not None
    assert len(sizes[0]) == 2 and max(sizes[0]) <= 60 // 2


def test_one_item_of_very_many_texts(spark, monkeypatch):
    """All texts of an item hash to one block; each pass stands in a table of its own."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    many = [("a", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(200)] + [("b", "one two three"), ("c", "nine eight")]
    bench = spark.createDataFrame(many, "item_id string, text string")
    docs = spark.createDataFrame([(1, "start " + many[7][1] + " end"), (2, "x one two three nine eight"), (3, "clean"), (None, many[9][1]), (4, None), (1, "one two three")], "doc_id long, text string")
    made = []
    table = scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, name: made.append(name) or table(df, name))
    found = decontaminate.decontaminate(docs, bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sum(x.startswith("pass-") for x in made) >= 2
    got = sorted((str(r.doc_id), r.n_hit, r["items"], r.clean) for r in found.collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1 << 20)
    assert got == sorted((str(r.doc_id), r.n_hit, r["items"], r.clean) for r in decontaminate.decontaminate(docs, bench).collect())
    assert [x[2] for x in got if x[0] == "2"] == [["b", "c"]]


def test_heads_go_by_many_ranges(spark, monkeypatch):
    """With a chunk for every few texts no range gets all of the heads."""
    monkeypatch.setattr(jaccard_join, "SLICE_BYTES", 2000)
    monkeypatch.setattr(jaccard_join, "HELD_PRINTS", 100)
    seen = {}
    table = scratch.table
    docs = spark.createDataFrame([(k, " ".join(f"w{k % 150}x{j}" for j in range(30))) for k in range(300)], "doc_id long, text string").repartition(4)

    def watched(df, name):
        if name == "documents":
            text = df._jdf.queryExecution().executedPlan().toString()
            seen[name] = text.count("FlatMapGroupsInArrow")
        return table(df, name)

    monkeypatch.setattr(scratch, "table", watched)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {k: k % 150 for k in range(300)} and seen["documents"] == 1


def test_rows_that_repeat_an_id_and_a_text(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words stand here in this text"), (None, "x y"), (None, "x y"), (2, None), (2, None), (3, "alone")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `an.other` long")
    got = sorted((str(r.doc_id), str(r.text)) for r in jaccard_join.first_of_groups(docs).collect())
    assert got == [("1", "a b c d e f g"), ("1", "other words stand here in this text"), ("2", "None"), ("3", "alone"), ("None", "x y"), ("None", "x y")]


def test_columns_with_dots(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "`an.id` long, `the.text` string")
    assert packing.pack(docs, id_col="an.id", text_col="the.text").count() == 2
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "`vec.id` long, `vec.tor` array<double>")
    assert topk.top_k(vectors, vectors.where("`vec.id` = 0"), id_col="vec.id", vector_col="vec.tor").count() == 4


@pytest.mark.parametrize("name", ["class='parish-register'", "class='rail-network'", "id='login-howto'", "class='notice-board'"])
def test_names_alone_remove_nothing_from_an_article(name):
    part = f"<section {name}><p>Kept: {PARAGRAPH}</p></section>"
    assert f"Kept: {PARAGRAPH.strip()}" in main_text(f"<html><body><nav>menu</nav><article><h1>T</h1><p>{PARAGRAPH}</p>{part}</article></body></html>")


def test_short_parts_sums_and_footers():
    text = main_text(f"<article><p>{PARAGRAPH}</p><div class='widgets'><p>Widgets are built in a shop.</p></div><p>The sum <math><mi>x</mi> = 42</math> holds.</p><div class='share'><a href=#>Share</a></div></article>")
    assert text.split("\n")[1:] == ["Widgets are built in a shop.", "The sum x = 42 holds."]
    text = main_text(f"<body><div class=content><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div>Copyright 2024 Foo Ltd. All rights reserved.</div></body>")
    assert text == "\n".join([PARAGRAPH.strip()] * 2)
