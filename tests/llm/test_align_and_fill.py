"""Token alignment and fill-in-middle against brute-force versions, with their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lexmere.llm import align_tokens, fill_middle, queries

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "  ", "a", " a", "a ", "  a b  c ", "\n x\n\n y \t z", "▁", "a▁b a b", "a ▁b", "héé ñ 😀 <|endoftext|> <s> x", "a\xa0 b 　c", "x" * 3000, "x y " * 2000, "é ﬁ Ａ​b \x00 ﻿q", "   a", "a's 'll 12 3 - -", "日本語 テキスト。 次の文", "<P> marked", "same", "same"]
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(-k, t) for k, t in enumerate(EDGE, 1)] + [(-1, "a repeated id"), (None, "no id"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def tokens():
    return align_tokens.Tokens(*align_tokens.default_files())


def aligned(tokens, text):
    """(tokens of A, of B, groups, links with their multiplicity, digest) of a whole text; None without tokens."""
    if not text:
        return None
    a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(tokens.a_bytes[k] for k in a) != raw or b"".join(tokens.b_bytes[k] for k in b) != raw:
        return None
    ends = [np.cumsum([len(names[k]) for k in ids]).tolist() for ids, names in ((a, tokens.a_bytes), (b, tokens.b_bytes))]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    of = [defaultdict(list), defaultdict(list)]
    for side, ids in enumerate((a, b)):
        for k, g in zip(ids, np.searchsorted(cuts, ends[side]).tolist()):
            of[side][g].append(k)
    links = Counter((x, y) for g in range(len(cuts)) for x in of[0][g] for y in of[1][g])
    text = ";".join(",".join(map(str, of[0][g])) + "|" + ",".join(map(str, of[1][g])) for g in range(len(cuts)))
    return len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest()


def expected(tokens, texts):
    found = [aligned(tokens, t) for t in texts]
    count = Counter(k for f in found if f for k in f[3])
    best: Counter = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if f is None else (*f[:3], sum(f[3].values()), sum(m for k, m in f[3].items() if count[k] == best[k[0]]), sum(m * count[k] for k, m in f[3].items()), f[4]) for f in found], count


def row(r):
    return (str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_alignment_equals_brute_force(docs, tokens):
    own = docs.collect()
    want, count = expected(tokens, [r.text for r in own])
    assert sum(w[0] == 0 for w in want) >= 5
    got = sorted(map(row, align_tokens.align(docs).collect()))
    assert got == sorted((str(r.doc_id), *w) for r, w in zip(own, want))
    assert {(r.a, r.b): r.n for r in align_tokens.links(docs).collect()} == dict(count)


def test_alignment_in_many_chunks_with_little_memory(docs, tokens, monkeypatch):
    """Chunks, slices and remembered pieces so small that all of them are cut and forgotten."""
    want, _ = expected(tokens, [r.text for r in docs.collect()])
    own = [r.text for r in docs.collect()]
    monkeypatch.setattr(align_tokens, "PIECES", 500)
    small = align_tokens.Aligner(tokens)
    for k in range(0, len(own), 7):
        facts, pairs = small.align(own[k : k + 7])
        for i, f in enumerate(facts):
            assert f == (*want[k + i][:3], want[k + i][6])
            assert int(pairs["times"][pairs["doc"] == i].sum()) == want[k + i][3]
    assert len(small.known) <= 500 or small.next


def test_alignment_carries_no_other_columns_and_takes_empty_tables(docs, spark):
    clash = docs.selectExpr("doc_id AS `an.id`", "text AS `chunk`", "1 AS doc_id", "2 AS text", "3 AS pairs", "4 AS range")
    got = sorted(map(row, align_tokens.align(clash, id_col="an.id", text_col="chunk").collect()))
    assert got == sorted(map(row, align_tokens.align(docs).collect()))
    assert align_tokens.align(docs.limit(0)).collect() == []
    assert align_tokens.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).agg({"n_links": "sum"}).first()[0] == 0


def test_rope_splits_and_joins():
    rnd = random.Random(3)
    leaf, fill_middle.LEAF = fill_middle.LEAF, 5
    try:
        for _ in range(3000):
            text = "".join(rnd.choice("abcZ .é<PSM>\n😀") for _ in range(rnd.randint(0, 60)))
            units, tree = UNIT.findall(text), fill_middle.rope(text)
            assert (tree.units, tree.chars) == (len(units), len(text))
            k = rnd.randint(0, len(units) + 1)
            a, b = fill_middle.split_units(tree, k)
            assert (fill_middle.text_of(a), fill_middle.text_of(b)) == ("".join(units[:k]), "".join(units[k:]))
            j = rnd.randint(0, len(text) + 1)
            a, b = fill_middle.split_chars(tree, j)
            assert (fill_middle.text_of(a), fill_middle.text_of(b)) == (text[:j], text[j:])
            for part in (a, b):  # both are ropes with right counts: they split again
                x, y = fill_middle.split_units(part, part.units // 2)
                assert x.units + y.units == part.units and fill_middle.text_of(x) + fill_middle.text_of(y) == fill_middle.text_of(part)
            found = fill_middle.arranged(rnd.randint(0, 9999), text)
            assert fill_middle.restored_text(found[1], found[4]) == text
    finally:
        fill_middle.LEAF = leaf


def plain_version(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_brute_force_and_comes_back(docs):
    got = sorted((str(r.doc_id), r.restored, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_middle.restore(fill_middle.transform(docs)).collect())
    assert got == sorted(((str(r.doc_id), r.text or "", *plain_version(r.doc_id, r.text)) for r in docs.collect()), key=lambda x: x[:2])
    assert {x[3] for x in got} == {"plain", "psm", "spm"}


def test_fill_middle_takes_columns_of_any_name_and_empty_tables(docs):
    clash = docs.selectExpr("doc_id AS `an.id`", "text AS `a text`", "1 AS output", "2 AS form")
    got = fill_middle.digest(fill_middle.transform(clash, id_col="an.id", text_col="a text"))
    assert sorted(map(str, got.collect())) == sorted(map(str, fill_middle.digest(fill_middle.transform(docs)).collect()))
    assert fill_middle.digest(fill_middle.transform(docs.limit(0))).collect() == []


def test_fill_middle_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_fill_middle"]).fetchall()
    names = [d[0] for d in con.description]
    got = queries.QUERIES["op13_fill_middle"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
