"""Streams in several batches, observed progress, search index, clustered files, tree walk, catalogue, word tables, uploads, settings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexmere.operators import catalogue, clustered, layout, manifest, rag, search, temporal, vector_index, word_tables
from lexmere.operators.access import Scope
from lexmere.sources import files as sources
from lexmere.streaming import progress, stateful

DAY = 86_400


@pytest.fixture(scope="module")
def events(spark):
    """Events of a few users with ties and one hot user, in order of time."""
    rnd = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    at = sorted(rnd.randint(0, 20 * DAY) for _ in range(900))
    rows = [(k, start + dt.timedelta(seconds=s, microseconds=rnd.choice([0, 0, 1, 500_000])), 1 if rnd.random() < 0.5 else rnd.randint(2, 9)) for k, s in enumerate(at)]
    rows += [(2000 + k, rows[100][1], 1) for k in range(4)]  # one moment, five events
    rows += [(5000, start, 99)]  # seen once, so that a later batch's timer ends the session
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "event_id long, ts timestamp, user_id long")


@pytest.fixture(scope="module")
def stream(spark, events, tmp_path_factory):
    """The same as a stream of files, a batch for each, cut by time so that nothing is late."""
    folder = tmp_path_factory.mktemp("events")
    for n in range(5):
        day = F.floor(F.unix_timestamp("ts") / (4 * DAY))
        first = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() // (4 * DAY))
        part = events.where(day == first + n) if n < 4 else events.where(day >= first + 4)
        part.coalesce(1).write.parquet(f"{folder}/{n}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_throttle_stream_equals_the_batch_query(events, stream):
    columns = ["user_id", "event_id", "in_window", "allowed", "retry_after"]
    for limit, window in ((3, DAY), (1, 60), (200, 9 * DAY)):
        got = stateful.drained(stateful.throttle(stream, limit, window), "throttle")
        want = temporal.throttle(events, limit, window)
        assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)


def test_session_stream_equals_the_batch_query(events, stream):
    got = stateful.drained(stateful.session_updates(stream, DAY // 2, 2 * DAY, 3600), "sessions").cache()
    seen = got.where("event_id IS NOT NULL")
    last = seen.groupBy("user_id", "session").agg(F.max("events"), F.min("started"), F.max("last_seen"))
    want = temporal.sessions(events, DAY // 2).select("user_id", "session", "events", F.unix_micros("started"), F.unix_micros("last_seen"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    touched = sorted(map(tuple, seen.where("touched").select("user_id", "event_id").collect()))
    assert touched == sorted(map(tuple, temporal.touches(events, 3600).select("user_id", "event_id").collect()))
    old = {(r.user_id, r.event_id) for r in seen.where("ended = 'age'").collect()}
    assert old == {(r.user_id, r.event_id) for r in seen.where(F.col("last_seen") - F.col("started") >= 2 * DAY * 1_000_000).collect()}
    # timers end sessions between batches, each with its reason
    assert {r.ended for r in got.where("event_id IS NULL").collect()} >= {"idle"}


def test_changes_are_seen_once(spark, stream):
    got = stateful.drained(stateful.changes(stream.withColumn("step", F.col("event_id") % 5), ["user_id", "step"], late="365 days"), "changes")
    assert got.count() == got.select("user_id", "step").distinct().count() == 46


def test_answers_overtaken_are_dropped(spark):
    rows = [("a", 1, 10), ("a", 2, 5), ("a", 3, 20), ("b", 1, 1), ("b", 2, 1)]
    got = temporal.not_overtaken(spark.createDataFrame(rows, "k string, ticket int, at int"), "k", "ticket", "at")
    assert sorted(map(tuple, got.select("k", "ticket").collect())) == [("a", 2), ("a", 3), ("b", 1), ("b", 2)]


FILES = [(f"p{k}", s, c, k) for k, (s, c) in enumerate([("indexed", 3), ("failed", 0), ("indexed", 2), ("skipped", 0), ("queued", 0), ("unsupported", 0)])]


def test_progress_of_a_batch_run(spark):
    rows = spark.createDataFrame(FILES, "path string, state string, chunks int, place int")
    run = progress.Run(spark, "r")
    out = run.stage("all", rows)
    run.stage("nothing", out.where("state = 'none'"), total=6)
    assert out.count() == 6
    first, second = run.snapshot().collect()
    assert (first.total, first.processed, first.indexed, first.failed, first.queued, first.chunks, first.progress, first.current_file) == (6, 5, 2, 1, 1, 5, 0.833, "p5")
    assert (second.total, second.processed, second.progress, second.current_file) == (6, 0, 0.0, None)


def test_progress_of_a_stream_is_there_between_batches(spark, tmp_path):
    rows = spark.createDataFrame(FILES, "path string, state string, chunks int, place int")
    for n in range(3):
        rows.where(F.col("place") % 3 == n).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = []
    whole = progress.Listener.onQueryProgress

    class Watched(progress.Listener):
        def onQueryProgress(self, event):
            whole(self, event)
            seen.append(self.snapshot("r")[3])

    listener, progress.Listener = progress.Listener, Watched
    try:
        got = progress.observed_stream(stream, "r", total=6).first()
    finally:
        progress.Listener = listener
    assert (got.total, got.processed, got.indexed, got.chunks, got.progress) == (6, 5, 2, 5, 0.833)
    assert seen[-1] == 5 and len(set(seen)) > 1


def _passages(spark, groups=12, each=25, dimension=8):
    rnd = random.Random(3)
    rows = []
    for g in range(groups):
        centre = [rnd.uniform(-1, 1) for _ in range(dimension)]
        for k in range(each):
            rows.append((str(g), k, [c + rnd.uniform(-0.03, 0.03) for c in centre], "heading" if k == 7 else None if k == 8 else "text", f"u{g % 3}", "public" if g % 4 == 0 else "private", "en" if g % 2 else "de", f"f{g}.pdf"))
    rows += [("x", 0, None, "text", "u0", "public", "en", "x.pdf"), ("0", 99, rows[0][2], "text", "u0", "public", "en", "f0.pdf")]
    return spark.createDataFrame(rows, "document_id string, chunk_index int, embedding array<double>, kind string, owner_id string, visibility string, language string, filename string")


def test_index_search_equals_a_scan_and_skips_lists(spark, monkeypatch):
    passages = _passages(spark)
    queries = passages.where("chunk_index % 9 = 0 AND embedding IS NOT NULL").select((F.xxhash64("document_id", "chunk_index")).alias("query_id"), F.col("embedding").alias("q"))
    index = vector_index.build(passages, 16)
    columns = ["query_id", "rank", "document_id", "chunk_index", "score"]
    for at_once in (1000, 7):
        monkeypatch.setattr(vector_index, "QUERY_ROWS", at_once)
        for k, filters, scope in ((3, None, None), (40, None, Scope("u1")), (5, {"language": "en"}, Scope("u2", "mine")), (5, {"language": "xx"}, None)):
            found, reads = vector_index.search(index, queries, k, filters, scope)
            want = search.vector_topk(passages, queries, k, filters, scope)
            assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
            if k == 3:
                assert reads.agg(F.avg(F.col("lists_read") / F.col("lists"))).first()[0] < 0.5
                assert reads.where("lists_read > lists OR rows_read > 400").count() == 0
    assert vector_index.build(passages.where("embedding IS NULL"), 4) is None
    assert vector_index.search(index, queries.limit(0), 3)[0].count() == 0
    with pytest.raises(ValueError):
        vector_index.build(passages, 0)


def test_clustered_passages_open_only_the_files_they_need(spark):
    passages = _passages(spark)
    path = clustered.write(passages, 12)
    files = clustered.spans(spark, path).count()
    found = clustered.read(spark, path, {"owner_id": "u1", "document_id": "4"})
    rows = found.collect()
    assert len(rows) == passages.where("owner_id = 'u1' AND document_id = '4'").count() == 25
    assert 0 < clustered.files_opened(found) < files / 2
    assert clustered.read(spark, path, {"owner_id": "nobody"}).count() == 0
    assert clustered.read(spark, path, {"language": None}).count() == 0
    with pytest.raises(ValueError):
        clustered.read(spark, path, {"filename": "f1.pdf"})


def test_dimension_is_checked(spark):
    passages = _passages(spark).where("embedding IS NOT NULL")
    assert search.check_dimension(passages, 8).agg(F.sum(F.size("embedding"))).first()[0] == 8 * passages.count()
    with pytest.raises(Exception, match="expected 9 numbers"):
        search.check_dimension(passages, 9).agg(F.sum(F.size("embedding"))).collect()


def test_catalogue_of_a_partitioned_and_an_absent_table(spark):
    spark.sql("DROP TABLE IF EXISTS kept_passages")
    _passages(spark).write.partitionBy("language").saveAsTable("kept_passages")
    rows = {r.name: r for r in catalogue.describe(spark, ["kept_passages", "no_table"]).collect()}
    assert rows["kept_passages"].partitioned_by == ["language"] and rows["kept_passages"].format == "parquet" and rows["kept_passages"].rows == 302
    assert rows["no_table"].present is False and rows["no_table"].rows is None
    assert [r.column for r in catalogue.columns(spark, ["kept_passages"]).orderBy("position").collect()][-1] == "language"
    spark.sql("DROP TABLE kept_passages")
    assert catalogue.describe(spark, ["no_table"]).collect()[0].present is False


def test_locale_order(spark):
    names = ["b", "Ä", "a", "Z", "é", "A", "ä", "B", "e"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in df.orderBy(*manifest.by_locale("name")).collect()] == ["A", "a", "Ä", "ä", "B", "b", "e", "é", "Z"]


def test_a_block_grows_as_it_is_continued(spark):
    line = lambda o, top, left, first, text: ("d", 1, o, text, top, left, first, top + 10.0, 10.0, False)
    kind = "doc string, page int, order int, text string, top double, left double, first_left double, bottom double, line_height double, monospace boolean"
    # the second line begins far left of the third; the block's edge has moved with it
    rows = [line(0, 100.0, 54.0, 54.0, "An indented line"), line(1, 112.0, 50.0, 51.0, "goes on here"), line(2, 124.0, 50.0, 46.5, "and here"), line(3, 136.0, 50.0, 50.0, "and ends."), line(4, 148.0, 50.0, 50.0, "A new one"), line(5, 190.0, 50.0, 50.0, "far below"), line(6, 195.0, 50.0, 50.0, "above its end")]
    got = layout.continuations(spark.createDataFrame(rows, kind), 10.0).orderBy("order").collect()
    assert [r.paragraph for r in got] == [1, 1, 1, 1, 2, 3, 4]
    kinds = spark.createDataFrame(rows, kind).withColumn("kind", F.when(F.col("order") == 1, "heading").otherwise("paragraph"))
    assert [r.paragraph for r in layout.continuations(kinds, 10.0).orderBy("order").collect()] == [1, 2, 3, 3, 4, 5, 6]
    assert layout.continuations(kinds.limit(0), 10.0).collect() == []


def test_tables_from_words(spark):
    w = lambda t, x, y, width=30: ("d", 1, t, float(x), float(y), float(x + width), float(y + 9))
    words = [w("Title", 50, 10), w("Item", 50, 100), w("Price", 150, 101), w("Blue", 50, 114), w("lamp", 84, 114), w("12", 150, 115), w("Chair", 50, 128), w("text", 50, 300), w("alone", 84, 300), w(None, 150, 128)]
    df = spark.createDataFrame(words, "doc string, page int, text string, left double, top double, right double, bottom double")
    got = word_tables.tables(df).collect()
    assert [r.markdown for r in got] == ["| Item | Price |\n| --- | --- |\n| Blue lamp | 12 |\n| Chair |  |"]
    regions = spark.createDataFrame([("d", 1, "in", 50.0, 100.0, 180.0, 120.0), ("d", 1, "out", 50.0, 300.0, 120.0, 309.0), ("d", 1, "half", 50.0, 127.0, 100.0, 160.0), ("e", 1, "other page", 50.0, 100.0, 180.0, 120.0), ("d", 1, "no area", 60.0, 110.0, 60.0, 120.0)], "doc string, page int, text string, left double, top double, right double, bottom double")
    assert sorted(r.text for r in word_tables.outside(regions, word_tables.tables(df)).collect()) == ["half", "no area", "other page", "out"]
    assert word_tables.tables(df.limit(0)).collect() == []


def test_each_rejection_is_used_once(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(["a", "a", "b", "c", "a"])], "batch int, place int, name string")
    refused = spark.createDataFrame([(1, 0, "a", "empty"), (1, 1, "a", "too large"), (1, 2, "zz", "no such row")], "batch int, place int, name string, reason string")
    saved = spark.createDataFrame([(1, 5, "a (2)", "id1"), (1, 9, "b", "id2"), (1, 11, "c", "id3")], "batch int, place int, name string, file_id string")
    got = [(r.name, r.state, r.error, r.file_id) for r in manifest.settled_uploads(rows, refused, saved).orderBy("place").collect()]
    assert got == [("a", "rejected", "too large", None), ("a (2)", "waiting", None, "id1"), ("b", "waiting", None, "id2"), ("c", "waiting", None, "id3"), ("a", "rejected", "not saved", None)]


def test_a_user_is_deleted_with_all_that_is_theirs(spark):
    users = spark.createDataFrame([("a", "A"), ("b", "B")], "user_id string, username string")
    owned = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "document_id string, owner_id string")
    kept, counts = manifest.without_user("a", users, owned, owned, owned.limit(0))
    assert {r.table: (r.removed, r["left"]) for r in counts.collect()} == {"users": (1, 1), "documents": (1, 2), "passages": (1, 2), "files": (0, 0)}
    assert [r.user_id for r in kept["users"].collect()] == ["b"] and sorted(r.document_id for r in kept["documents"].collect()) == ["2", "3"]


def test_settings_and_their_defaults(spark):
    rows = spark.createDataFrame([("top_k", "25"), ("rerank", "true"), ("model", "not json"), ("gone", None)], "key string, value string")
    got = {r.key: (r.kind, r.value) for r in manifest.settings(rows, {"top_k": "10", "rerank": "false", "model": '"small"', "gone": "[1,2]", "unset": "1.5"}).collect()}
    assert {k: v for k, (_, v) in got.items()} == {"top_k": "25", "rerank": "true", "model": '"small"', "gone": "[1,2]", "unset": "1.5"}
    assert got["top_k"][0] == "BIGINT" and got["rerank"][0] == "BOOLEAN"


def test_a_failed_reranker_keeps_the_order_of_the_search(spark):
    hits = spark.createDataFrame([(a, "q", r, f"{a}{r}", 0, f"text {r}") for a in (1, 2) for r in (1, 2, 3)], "ask_id int, question string, rank int, document_id string, chunk_index int, text string")
    score = F.when((F.col("ask_id") == 1) | (F.col("rank") != 2), F.col("rank") / 10)
    got = {(r.ask_id, r.rank): (r.place, r.rerank) for r in rag.rerank_or_search(hits, 5, score).collect()}
    assert got == {(1, 1): (3, 0.1), (1, 2): (2, 0.2), (1, 3): (1, 0.3), (2, 1): (1, None), (2, 2): (2, None), (2, 3): (3, None)}


def test_evaluation_sets_are_read(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text('{"cases": [{"id": "a", "query": "q", "expect": [{"filename": "f.pdf", "page": 3}]}, {"id": "b", "query": "r", "expect": []}]}')
    got = sources.eval_cases(spark, str(path)).orderBy("id").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].expect[0].page == 3


def test_tree_walk_of_several_roots(spark, tmp_path):
    from lexmere.sources import walk

    for name in ("a/x.pdf", "a/sub/y.docx", "a/sub/deep/z.pdf", "a/users/u1/mine.pdf", "b/x.pdf", "b/.hidden.pdf", "b/note.txt", "a/__MACOSX/m.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    every = [r.path for r in walk.walk(spark, [b, a, f"{a}/sub", str(tmp_path / "none")]).collect()]
    assert every == sorted(every) and len(every) == 8 and len(set(every)) == 8
    got = walk.library(spark, [a, b], f"{a}/users").collect()
    assert [r.path.removeprefix(f"{tmp_path}/") for r in got] == ["a/sub/deep/z.pdf", "a/sub/y.docx", "a/x.pdf", "b/x.pdf"]
    assert got[0].length == len("a/sub/deep/z.pdf") and got[0].modified_at is not None
    assert walk.walk(spark, [str(tmp_path / "none")]).count() == 0


def test_tree_walk_prunes_by_a_filter(spark, tmp_path):
    from pyspark.sql.datasource import Not, StringStartsWith

    from lexmere.sources import walk

    for name in ("a/x.pdf", "a/users/u1/mine.pdf", "a/users2/y.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    reader = walk.Walk({"roots": str(tmp_path)})
    assert list(reader.pushFilters([Not(StringStartsWith(("path",), f"{tmp_path}/a/users/"))])) == []
    found = [p for part in reader.partitions() for p, *_ in reader.read(part)]
    assert sorted(x.removeprefix(f"{tmp_path}/") for x in found) == ["a/users2/y.pdf", "a/x.pdf"]
    assert not any("/users/" in part.path for part in reader.partitions())
    got = walk.walk(spark, [str(tmp_path)]).where(~F.startswith(F.col("path"), F.lit(f"{tmp_path}/a/users/")))
    assert got.count() == 2


def test_moved_folders_keep_names_apart(spark):
    from lexmere.operators import tree

    rows = [("1", None, "top"), ("2", "1", "É"), ("3", None, "É"), ("4", None, "é"), ("5", "1", "abc"), ("6", None, "ABC")]
    folders = spark.createDataFrame(rows, "folder_id string, parent_id string, name string")
    name = lambda moved: tree.move(folders, moved, "1").where(F.col("folder_id") == moved).first()["name"]
    assert [name("3"), name("4"), name("6")] == ["É (2)", "é", "ABC (2)"]


def test_of_two_writers_one_gets_the_version(spark, tmp_path):
    from lexmere.streaming.indexing import Conflict, Snapshots, sweep

    kind = "document_id string, filepath string, alt_filepaths array<string>"
    table = Snapshots(spark, str(tmp_path / "t"), kind, buckets=4)
    rows = spark.createDataFrame([(f"d{k}", f"/p{k}", ["/q"] if k == 1 else None) for k in range(12)], kind)
    table.commit(rows, 0)
    with pytest.raises(Conflict):
        table.commit(rows.limit(1), 0)
    listing = rows.where("document_id <> 'd1' AND document_id <> 'd2'").selectExpr("filepath AS path").unionByName(spark.createDataFrame([("/q",)], "path string"))
    assert sweep(table, listing) == 2 and table.read().count() == 11
    assert table.read().where("document_id = 'd1'").first()["filepath"] == "/q"
    before, after = table._files(1), table._files(2)
    assert 0 < sum(before[b] != after.get(b) for b in before) <= 2
    assert sweep(table, listing) == 2  # nothing to do, no new version


def test_a_space_before_a_page_break_keeps_words_apart(spark):
    kind = "doc string, page int, paragraph int, text string, trailing_space boolean"
    rows = [("a", 1, 1, "필터를 교", True), ("a", 2, 1, "체합니다 다음", False), ("b", 1, 1, "필터를 교", False), ("b", 2, 1, "체합니다 다음", False)]
    got = {(r.doc, r.page): r.text for r in layout.across_pages(spark.createDataFrame(rows, kind), midword=True).collect()}
    assert got["b", 1] == "필터를 교체합니다" and got["a", 1] == "필터를 교"


def test_many_queries_come_in_passes(spark, monkeypatch):
    passages = _passages(spark)
    queries = passages.where("chunk_index % 5 = 0 AND embedding IS NOT NULL").select(F.xxhash64("document_id", "chunk_index").alias("query_id"), F.col("embedding").alias("q"))
    columns = ["query_id", "rank", "document_id", "chunk_index", "score"]
    one = sorted(map(tuple, search.vector_topk(passages, queries, 4).select(columns).collect()))
    monkeypatch.setattr(search, "QUERY_ROWS", 9)
    found = search.vector_topk(passages, queries, 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0  # the passes stand in tables
    assert sorted(map(tuple, found.select(columns).collect())) == one


def test_streamed_languages_are_those_of_the_functions(spark):
    from lexmere.functions import text as T
    from lexmere.streaming import answers

    texts = ["필터 교체", "필터 濾芯 カ", "カタカナ", "更换滤芯这个们来时", "更換濾芯這個們來時", "這個們 plain words here and more", "plain English", "привет мир", "12 + 3", "", "é ü", "更换 a b c", "濾芯", "中文 ab", "ʻokina ɐ"]
    rows = spark.createDataFrame([(t, w) for t in texts for w in ("en", "ko", "zh-Hans", "zh-Hant")], "t string, want string")
    got = rows.select("t", "want", T.question_language(F.col("t")).alias("found"), T.is_in_language(F.col("t"), F.col("want")).alias("passes")).collect()
    for r in got:
        assert (answers.language_of(r.t), answers.passes(r.t, r.want)) == (r.found, r.passes), (r.t, r.want)


def test_places_in_one_order(spark):
    rows = spark.createDataFrame([(k * 37 % 1000, "x" if k % 3 else None) for k in range(1000)] + [(None, "n")], "k int, own string").repartition(5)
    got = sorted((r.place, -1 if r.k is None else r.k) for r in manifest.numbered(rows, "k").collect())
    assert got == [(i + 1, k) for i, k in enumerate(range(-1, 1000))]
    assert manifest.numbered(rows.limit(0), "k").count() == 0
    same = manifest.numbered(spark.createDataFrame([(1,)] * 50, "k int"), "k", into="p")
    assert same.columns == ["k", "p"] and sorted(r.p for r in same.collect()) == list(range(1, 51))


def test_rows_deleted_by_key(spark, tmp_path):
    from lexmere.streaming.indexing import Snapshots

    kind = "document_id string, n long"
    table = Snapshots(spark, str(tmp_path / "t"), kind, buckets=8)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "document_id string")
    assert table.delete(keys("d1")) == 0 and table.clear() == 0
    table.merge(spark.createDataFrame([(f"d{k}", k) for k in range(40)], kind))
    base = table.current()
    assert table.delete(keys("d1", "d1", "d2", "none", None)) == 2 and table.read().count() == 38
    before, after = table._files(base), table._files(base + 1)
    assert 0 < sum(before[b] != after.get(b) for b in before) <= 2
    assert table.delete(keys("none")) == 0 and table.current() == base + 1
    assert table.clear() == 38 and table.read().count() == 0 and table.read(base).count() == 40


def test_tables_of_a_library_change_together(spark, tmp_path):
    from lexmere.streaming.indexing import Conflict, Library

    kinds = {"a": ("document_id string, n long", "document_id"), "b": ("id long, document_id string", "id")}
    library = Library(spark, str(tmp_path / "l"), kinds, buckets=4)
    a = spark.createDataFrame([(f"d{k}", k) for k in range(9)], kinds["a"][0])
    b = spark.createDataFrame([(k, f"d{k % 9}") for k in range(30)], kinds["b"][0])
    assert library.change(lambda held: {"a": a, "b": b}) == 1

    def broken(held):
        # the second table fails while it is written, when the first one's files are there
        return {"a": held["a"].where("n > 5"), "b": held["b"].selectExpr("id", "raise_error('no') AS document_id")}

    with pytest.raises(Exception, match="no"):
        library.change(broken)
    assert library.current() == 1 and library.read("a").count() == 9 and library.read("b").count() == 30

    raced = []

    def late(held):
        if not raced:
            raced.append(1)
            Library(spark, str(tmp_path / "l"), kinds, buckets=4).change(lambda other: {"b": other["b"].where("id < 20")})
        return {"a": held["a"].where("n <> 3"), "b": held["b"].where("document_id <> 'd3'")}

    assert library.change(late) == 3
    assert library.read("a").count() == 8 and library.read("b").count() == sum(k % 9 != 3 for k in range(20)) and library.read("b", 1).count() == 30
    # a table that is not named stays
    assert library.change(lambda held: {"a": held["a"].limit(0)}) == 4 and library.read("a").count() == 0 and library.read("b").count() == 18
    with pytest.raises(Conflict):
        library.change(lambda held: library.change(lambda other: {"a": other["a"]}) and {"a": held["a"]}, tries=1)


def test_documents_without_passages_are_told_apart(spark):
    found = spark.createDataFrame([("a", "extracted", None), ("b", "extracted", None), ("c", "failed", "broken"), ("d", None, None), ("e", "unsupported", "old file")], "document_id string, status string, error_message string")
    passages = spark.createDataFrame([("a",), ("a",), ("c",), ("x",), (None,)], "document_id string")
    got = {r.document_id: (r.status, r.error_message, r.chunks) for r in manifest.settled(found, passages).collect()}
    assert got == {"a": ("indexed", None, 2), "b": ("unsupported", "no passages", 0), "c": ("failed", "broken", 0), "d": (None, None, 0), "e": ("unsupported", "old file", 0)}
