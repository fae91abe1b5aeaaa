"""What the third review found, at small sizes."""

from __future__ import annotations

import pytest

from lexmere.operators import tree

FOLDER = "folder_id string, parent_id string, name string"


@pytest.fixture
def few_rows(spark):
    """A session whose recursive queries end at a few rows, as those over large trees do at a million."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "40")
    yield spark
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def _wide(spark):
    """Two folders, thirty in each, and one below one of these."""
    rows = [("a", None, "a"), ("b", None, "b"), ("deep", "a0", "deep")]
    return spark.createDataFrame(rows + [(f"{p}{k}", p, f"{p}{k}") for p in "ab" for k in range(30)], FOLDER)


def test_heights_of_many_folders(few_rows):
    heights = {r.folder_id: r.height for r in tree.heights(_wide(few_rows)).collect()}
    assert len(heights) == 63
    assert {f: h for f, h in heights.items() if h > 1} == {"a": 3, "b": 2, "a0": 2}
    assert tree.paths(_wide(few_rows)).count() == 63
    # a ring has no end: it is walked for as many levels as a tree may have
    ring = few_rows.createDataFrame([("x", "y", "x"), ("y", "x", "y"), ("z", "y", "z")], FOLDER)
    assert {r.folder_id: r.height for r in tree.heights(ring).collect()} == {"x": 20, "y": 20, "z": 1}


def test_move_among_many_folders(few_rows):
    moved = {r.folder_id: r.parent_id for r in tree.move(_wide(few_rows), "a", "b").collect()}
    assert moved["a"] == "b" and moved["deep"] == "a0" and len(moved) == 63
    chain = few_rows.createDataFrame([(str(k), str(k - 1) if k else None, "n") for k in range(18)] + [("m", None, "m"), ("n", "m", "n"), ("o", "n", "o")], FOLDER)
    with pytest.raises(ValueError, match="too deep"):
        tree.move(chain, "m", "17")
    assert tree.move(chain, "n", "17").count() == 21


def test_every_text_has_a_language(spark, tmp_path):
    from lexmere.plans.registry import QUERIES

    text = "필터 교체 방법을 설명하는 문서입니다"
    rows = [(8, text), (None, text), (-3, text), (None, "12 34"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id or 0, r.language or "") for r in QUERIES["language_label"](spark, str(tmp_path)).collect()))
    assert got == [(-3, "ko"), (0, ""), (0, "ko"), (8, "ko")]


def test_a_long_compound_keeps_its_hyphens(spark):
    from pyspark.sql import functions as F

    from lexmere.functions import text

    lines = [f"{word}-" for word in ["Orshon"] * 20 + ["haon"] * 20] + ["end"]
    made = F.array(*[F.struct(F.lit(x).alias("text"), F.lit(False).alias("trailing_space")) for x in lines])
    assert spark.range(1).select(text.join_wrapped_lines(made)).first()[0] == "".join(lines)


def test_products_of_an_index_in_blocks():
    import tracemalloc

    import numpy as np

    from lexmere.operators import vector_index

    x, centroids = np.random.default_rng(1).normal(size=(6000, 8)), np.random.default_rng(2).normal(size=(1500, 8))
    tracemalloc.start()
    near, far = vector_index._nearest(x, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
    every = ((x[:50, None] - centroids[None]) ** 2).sum(2)
    assert near[:50].tolist() == every.argmin(1).tolist() and np.allclose(far[:50], np.sqrt(every.min(1)))


def test_best_rows_of_a_task():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lexmere.operators.search import Best

    rng = np.random.default_rng(3)
    c, q = np.round(rng.normal(size=(6000, 8)), 1), rng.normal(size=(3000, 8))
    c[1000:4000] = c[0]  # copies: ties by index
    tracemalloc.start()
    best = Best(q, 3, 6)
    for a in range(0, 6000, 2500):
        n = len(c[a : a + 2500])
        best.meet(np.arange(len(q)), c[a : a + 2500], pa.array(["d"] * n), pa.array(np.arange(a, a + n)))
    found = best.found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    got = found["chunk_index"].to_numpy().reshape(3000, 3)
    for n in range(0, 3000, 100):
        assert got[n].tolist() == np.lexsort((np.arange(6000), -np.round(c @ q[n], 6)))[:3].tolist()


def test_a_text_is_digested_once(spark):
    from pyspark.sql import functions as F

    from lexmere.functions import ids

    rows = spark.createDataFrame([("a",), (None,)], "text string").select(ids.hash_embedding(F.col("text"), 48).alias("v"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    got = [r.v for r in rows.collect()]
    assert len(got[0]) == 48 and abs(sum(x * x for x in got[0]) - 1) < 1e-9 and set(got[1]) == {None}


class _Held:
    """A table whose mapInArrow gives the function back."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_documents_are_chunked_in_slices(spark):
    import pyarrow as pa

    from lexmere.operators import chunking

    pages = [{"page_number": 1, "blocks": [{"kind": "paragraph", "text": "one two three"}]}]
    batch = pa.RecordBatch.from_pylist([{"document_id": str(n), "pages": pages} for n in range(100)])
    made = list(chunking.chunk(_Held())(iter([batch])))
    assert [x for b in made for x in b.column(0).to_pylist()] == [str(n) for n in range(100)]
    assert max(b.num_rows for b in made) <= chunking.SLICE


def test_hits_are_ranked_without_their_texts(spark):
    from lexmere.plans import derived

    plan = derived.hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[k + 1] for k, line in enumerate(plan) if "Window [" in line]
    assert below and not any("text" in line or "question" in line for line in below)


def test_events_reach_the_sessions_packed_by_user(monkeypatch):
    import pyarrow as pa

    from lexmere.streaming import stateful

    monkeypatch.setattr(stateful, "PACKED", 200)
    rows = [{"user_id": k % 3, "event_id": None if k == 7 else k, "t": 1000 - k} for k in range(250)]
    packs = [r for b in stateful._packs(iter([pa.RecordBatch.from_pylist(rows[k : k + 10]) for k in range(0, 250, 10)])) for r in b.to_pylist()]
    assert [p["user_id"] for p in packs] == [0, 1, 2, 2, 0, 1]
    assert all(p["newest"] == max(p["times"]) for p in packs)
    assert sorted((p["user_id"], t, str(e)) for p in packs for t, e in zip(p["times"], p["event_ids"])) == sorted((r["user_id"], r["t"], str(r["event_id"])) for r in rows)


def test_a_new_user_asks_for_no_timers():
    from pyspark.sql import Row

    from lexmere.streaming import stateful

    class Kept:
        """State and timers of one user."""

        held, timers, listed = None, [], 0

        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            return self.held

        def update(self, held):
            self.held = held

        def listTimers(self):  # noqa: N802
            self.listed += 1
            return iter(self.timers)

        def deleteTimer(self, at):  # noqa: N802
            self.timers = [t for t in self.timers if t != at]

        def registerTimer(self, at):  # noqa: N802
            self.timers = [*self.timers, at]

    kept, sessions = Kept(), stateful.Sessions(10, 100, 1)
    sessions.init(kept)
    second = 1_000_000
    seen = [e for row in sessions.handleInputRows((5,), iter([Row(times=[3 * second, second], event_ids=[3, None]), Row(times=[second], event_ids=[1])]), None) for e in row.seen]
    assert [(e[0], e[4]) for e in seen] == [(1, 1), (None, 2), (3, 3)]
    assert (kept.listed, kept.timers) == (0, [13_001])
    list(sessions.handleInputRows((5,), iter([Row(times=[20 * second], event_ids=[4])]), None))
    assert (kept.listed, kept.timers, kept.held[:4]) == (1, [30_001], (2, 20 * second, 20 * second, 1))


def test_an_event_out_of_order_does_not_move_a_session_back(spark, tmp_path):
    import datetime as dt

    from lexmere.streaming import stateful

    batches = [[(1, dt.datetime(2024, 1, 1, 10), 1)], [(2, dt.datetime(2024, 1, 1, 9, 30), 1), (3, dt.datetime(2024, 1, 2, 9, 45), 1)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int").coalesce(1).write.parquet(f"{tmp_path}/{n}")
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = stateful.drained(stateful.session_updates(stream, 86_400, 864_000, 3600), "sessions").where("event_id IS NOT NULL").orderBy("event_id")
    assert [(r.event_id, r.session, r.events) for r in got.collect()] == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]


def _same_as_sql(spark, folder, name):
    import duckdb

    from lexmere.plans.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    assert want and sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=str) == sorted(want, key=str)


def test_streams_of_a_table_in_many_files(spark, tmp_path):
    # 80 files, none of them cut by time
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(80, "event_id").write.option("maxRecordsPerFile", 13).parquet(f"{tmp_path}/events.parquet")
    assert len(list(tmp_path.glob("events.parquet/*.parquet"))) > 64
    for name in ("session_stream_live", "throttle_stream"):
        _same_as_sql(spark, tmp_path, name)


def test_sessions_count_events_without_ids_and_users(spark, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumns({"event_id": F.when(F.col("event_id") % 5 > 0, F.col("event_id")), "user_id": F.when(F.col("event_id") % 7 > 0, F.col("user_id"))}).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("session_stream_live", "session_stream_touches"):
        _same_as_sql(spark, tmp_path, name)
