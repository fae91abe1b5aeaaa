"""Small cases of what a reviewer of round 4 found on larger tables."""

import numpy as np

from lexmere.llm import jaccard_join, lm_score, scratch


def _keys(sets, percent):
    levels, known = jaccard_join.Levels(percent), {}
    with np.errstate(over="ignore"):
        return [set(np.concatenate([np.empty(0, np.uint64), *jaccard_join.signatures(x, jaccard_join.mix(x ^ jaccard_join.SALT_B), levels, known)]).tolist()) for x in sets]


def test_unlike_sets_share_no_keys():
    """Keys of empty parts tied most sets of a size into one component, whose pieces then all met."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False)) for n in range(40, 1640, 4)]
    keys = _keys(sets, 80)
    every = [k for x in keys for k in x]
    assert len(set(every)) == len(every)


def test_linked_sets_share_a_key():
    """Whatever a set leaves out: sets of all sizes up to 60 and some larger, as unlike and as skewed as a link allows."""
    rng = np.random.default_rng(6)
    for percent in (50, 80, 85, 97):
        for n in [*range(2, 60), 130, 400, 999]:
            for bits in (64, 58):  # 58: all shingles lie in few parts
                pool = rng.permutation(np.unique(rng.integers(0, 2**bits, 3 * n, np.uint64, endpoint=False)))
                for more in {0, n // 9, n * 100 // percent - n}:
                    apart = next((k for k in range(n, -1, -1) if 100 * (n - k) >= percent * (n + more + k)), 0)  # so many of n are replaced
                    a = np.sort(pool[:n])
                    b = np.sort(np.concatenate([a[rng.permutation(n)[: n - apart]], pool[n : n + apart + more]]))
                    same = len(np.intersect1d(a, b))
                    if 100 * same >= percent * (len(a) + len(b) - same) and len(a) + len(b) > 2 * same:
                        x, y = _keys([a, b], percent)
                        assert x & y, (percent, n, bits, more, apart)


def test_ranges_follow_the_words(spark, monkeypatch):
    """There were as many ranges as input partitions, so a range's keys grew with the texts."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3000, 200))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    targets = docs.where("doc_id % 3 = 0").select("doc_id")
    want = [tuple(r) for r in lm_score.cross_entropy_difference(docs, targets).orderBy("doc_id").collect()]
    tables, table = {}, scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, name: tables.setdefault(name, table(df, name)))
    monkeypatch.setattr(lm_score, "RANGE_KEYS", 100, raising=False)
    got = [tuple(r) for r in lm_score.cross_entropy_difference(docs, targets).orderBy("doc_id").collect()]
    assert tables["words"].select("range").distinct().count() > 20
    assert got == want
