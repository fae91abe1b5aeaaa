"""Weak supervision: the label model on votes of known accuracy, terms by brute force, held-out accuracy, edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexmere.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(4)
    n, share, right = 60_000, 0.3, [0.9, 0.8, 0.7, 0.85, 0.6]
    y = (rng.random(n) < share).astype(int)
    sign = 2 * y - 1
    votes = np.stack([np.where(rng.random(n) < r, sign, -sign) * (rng.random(n) < 0.7) for r in right], 1)
    again = np.where(rng.random(n) < 0.95, votes[:, 1], 0)  # a voter that repeats the second
    votes = np.concatenate([votes, again[:, None]], 1).astype(np.int8)
    f = toxicity.indicators(votes)
    with_label = (f[:5000] * (y[:5000] - share)[:, None]).mean(0)
    model = toxicity.LabelModel(f.mean(0), f.T @ f / n, with_label, share)
    assert np.abs(model.accuracies()[:5] - right).max() < 0.06
    assert model.dependent[1, 5] and not model.dependent[0, 3]
    k = votes.shape[1]
    alone, pair = model.weight[3] - model.weight[3 + k], model.weight[1] - model.weight[1 + k] + model.weight[5] - model.weight[5 + k]
    assert pair < alone  # two copies of a weaker voter together stay below one better voter
    model.calibrate(votes[:5000], y[:5000], np.ones(5000))
    p = model.posterior(votes)
    assert ((p > 0.5) == y).mean() > ((np.sign(votes.sum(1)) > 0) == y).mean()
    sure = p > 0.9
    assert y[sure].mean() > 0.85


def test_terms_are_words_and_their_beginnings():
    texts = ["Été idiot idiot, IDIOTS!! s*it", None, "", "AAA BBB CCC one one one", "x" * 700_000 + " end"]
    terms = toxicity.Terms(pa.array(texts))
    assert terms.n.tolist() == [6, 0, 0, 6, 2]
    by = {(k, int(w)): int(h) for k, words, hashes in terms.hashes() for w, h in zip(words, hashes)}
    assert by[0, 1] == by[0, 2] != by[0, 3] and by[1, 1] == by[1, 3]  # words; their first three bytes
    assert terms.patterns().astype(int).tolist() == [[1, 0, 1, 0], [0] * 4, [0] * 4, [0, 1, 0, 1], [0] * 4]
    lower = toxicity.Terms(pa.array(["été"]))
    assert next(lower.hashes())[2][0] == next(terms.hashes())[2][0]


def test_mined_terms_equal_brute_force(spark, docs, labels):
    rows = docs.join(labels, "doc_id").select(toxicity.F.col("toxic").alias("label"), "text").collect()
    toxic, clean = sum(r.label == 1 for r in rows), sum(r.label == 0 for r in rows)
    names, kind, _, solid = toxicity._mined(spark.createDataFrame(rows, "label int, text string").repartition(5), toxic, clean)
    pos, neg = Counter(), Counter()
    for r in rows:
        raw = re.sub(rb"\xc3([\x80-\x9e])", lambda m: bytes([0xC3, m[1][0] + 32]), (r.text or "").encode().lower())
        own = set()
        for w in set(re.findall(rb"[a-z\x80-\xff]+", raw)):
            own |= {(0, w)} | {(k, w[:size]) for k, size in enumerate(toxicity.PREFIXES, 1) if len(w) > size}
        (pos if r.label else neg).update(own)
    wanted = 0
    for t, p in pos.items():
        if p >= toxicity.LEAST_TEXTS:
            z = (np.log(((p + 0.1) / (toxic + 0.2)) / ((neg[t] + 0.1) / (clean + 0.2))) - toxicity.LEAST_LIFT) / (1 / (p + 0.5) + 1 / (neg[t] + 0.5)) ** 0.5
            wanted += z > toxicity.LEAST_Z
    assert len(names) == min(wanted, toxicity.TERMS) and len(np.unique(names)) == len(names)
    assert set(kind.tolist()) <= set(range(7)) and 0 < solid.sum() <= len(solid)


def test_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op11_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in own) / len(own) > 0.985
    assert sum(r.predicted for r in own if r.toxic) / sum(r.toxic for r in own) > 0.9
    assert sum(1 - r.predicted for r in own if not r.toxic) / sum(1 - r.toxic for r in own) > 0.99


def test_held_out_labels_and_other_columns_change_nothing(spark, docs, labels):
    want = sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect())
    changed = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic"))).withColumn("quality", toxicity.F.lit(1))
    clash = docs.selectExpr("doc_id", "text", "'xx' AS lang", "9 AS label", "8 AS key", "7 AS score", "6 AS n")
    assert sorted((r.doc_id, r.score) for r in toxicity.toxicity(clash, changed).collect()) == want


def test_edges(spark, docs, labels):
    long = "a clean text of many words " * 40_000 + "you idiot"
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, long), (-4, long), (None, "scum"), (-5, "12 !! ***")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    strange = labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (-1, None), (-2, 7), (-9, 1), (-3, 0), (-3, 0)], "doc_id long, toxic int"))
    got = toxicity.toxicity(both, strange).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (-1, -2, -3)}) == 1 and all(not r.predicted for r in got if r.doc_id in (-1, -2, -3))
    assert len({r.score for r in got if r.doc_id == -4}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = strange.limit(0)
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(odd, spark.createDataFrame([(k, 1) for k in range(1, 9)], "doc_id long, toxic int")).collect()} == {1.0}
    few = spark.createDataFrame([(k, k % 2) for k in range(-5, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(odd, few).collect())
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
