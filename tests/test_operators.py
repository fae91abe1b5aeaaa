"""Operators on small rows, and every registered query against DuckDB on the smallest tables."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmere.operators import access, layout, manifest, rag, temporal, tree, viewer
from lexmere.plans.registry import ORACLE_SQL, QUERIES
from lexmere.sources import docx, files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    def plain(x):
        return float(round(x, 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(rows, got.columns) == rows_of(want.fetchall(), want.columns)
    else:
        assert rows


def test_scopes_and_requests():
    assert access.scope_for(None, False, "mine").mode == "public"
    assert access.scope_for("a", True).user_id is None
    assert access.user_filters({"owner_id": "x", "language": "en"}, False) == {"language": "en"}
    assert access.check_search(" q ", 500) == ("q", 100)
    with pytest.raises(ValueError):
        access.check_search("  ", 1)
    with pytest.raises(ValueError):
        access.Scope("u", "other")


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["vector_topk_filtered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BroadcastHashJoin" in plan
    single = QUERIES["vector_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in single


def test_source_packing_skips_and_keeps_the_first(spark):
    hits = spark.createDataFrame([("q", 1, "a" * 900, 1.0), ("q", 2, "a" * 900 + " ", 1.0), ("q", 3, "b" * 900, 1.0), ("q", 4, "c", 1.0)], "ask_id string, place int, text string, rerank double")
    kept = rag.pack_sources(hits, 5, 400).first()["sources"]
    assert [s["place"] for s in kept] == [1, 4]


def test_unique_names_without_a_limit(spark):
    taken = ["a (3).txt", "a (2).txt", "a (1000).txt", "a (02).txt", "a (99999999999999999999).txt", "b.txt", "b (3).txt", "c", "c (2)", "other.pdf"]
    names = ["a.txt"] * 2500 + ["b.txt"] * 3 + ["c"] * 2 + ["b (3).txt"] * 2 + [".d"] * 2
    want = []
    for name in dict.fromkeys(names):
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if dot else (name, "")
        free = (o for k in range(1, 9999) if (o := name if k == 1 else f"{stem} ({k}){ext}") not in taken)
        want += [(p, name, next(free)) for p, n in enumerate(names) if n == name]
    wanted = spark.createDataFrame(list(enumerate(names)), "position long, name string")
    got = manifest.unique_names(wanted, spark.createDataFrame([(n,) for n in taken], "name string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_searches_cover_every_query(spark, monkeypatch):
    from lexmere.operators import search

    monkeypatch.setattr(search, "QUERY_ROWS", 300)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = {r.vec_id for r in rows.where("vec_id % 50 = 0").collect()}
    got = QUERIES["vector_batch_topk"](spark, SF).collect()
    assert {r.query_id for r in got} == want and len(got) == 10 * len(want)
    assert QUERIES["retrieval_metrics"](spark, SF).first().cases == rows.count()


def test_whole_tables_are_read(spark):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("events", "lineitem", "documents")}
    assert QUERIES["event_messages"](spark, SF).count() == rows["events"].count()
    assert QUERIES["body_font_mode"](spark, SF).count() == rows["lineitem"].select("l_orderkey").distinct().count()
    assert QUERIES["name_hashes"](spark, SF).count() == rows["documents"].count()


def test_stream_text(spark):
    lines = ['data: {"choices":[{"delta":{"content":"hi"}}]}', "data: [DONE]", ": note", "data: {bad", 'data: {"choices":[{"delta":{}}]}']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(rag.delta_text(F.col("l"))).collect()]
    assert got == ["hi", None, None, None, None]
    s = "event: results\r\ndata: 1\r\ndata: 2\r\n\r\n: ping\n\ndata: x"
    e = spark.createDataFrame([(s,)], "s string").select(rag.event_blocks(F.col("s")).alias("e")).first()["e"]
    assert [(x["event"], x["data"]) for x in e] == [("results", "1\n2"), ("message", "x")]


def test_tree_rules(spark):
    f = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", None, "b")], "folder_id string, parent_id string, name string")
    with pytest.raises(ValueError):
        tree.move(f, "a", "c")
    moved = {r["folder_id"]: (r["parent_id"], r["name"]) for r in tree.move(f, "d", "a").collect()}
    assert moved["d"] == ("a", "b (2)")
    with pytest.raises(ValueError):
        tree.create(f, "x", "a", "b")
    assert tree.create(f, "x", "c", "new").count() == 5


def test_snapshots_of_rows(spark):
    t = spark.createDataFrame([("a", "p", ["q"]), ("b", "r", [])], "document_id string, filepath string, alt_filepaths array<string>")
    left = {r["document_id"]: (r["filepath"], r["alt_filepaths"]) for r in manifest.forget_path(t, "p").collect()}
    assert left == {"a": ("q", []), "b": ("r", [])}
    assert manifest.forget_path(t, "r").count() == 1
    jobs = spark.createDataFrame([(1, "running", None), (2, "done", None)], "id int, status string, finished_at timestamp")
    assert {r["id"]: r["status"] for r in temporal.abandoned(jobs, F.current_timestamp()).collect()} == {1: "failed", 2: "done"}


def word(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{docx.W[1:-1]}"><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style><w:style w:styleId="K"><w:basedOn w:val="H"/></w:style></w:styles>')
    return out.getvalue()


def para(text: str, style: str = "") -> str:
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def test_word_documents(spark):
    row = "<w:tr><w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc></w:tr>"
    body = para("Title here", "K") + para("A paragraph that is long enough.") + '<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:r><w:br w:type="page"/><w:t>next page</w:t></w:r></w:p>' + f"<w:tbl>{row.format('a', 'b')}{row.format('c', 'd')}</w:tbl>"
    df = spark.createDataFrame([("/x/a.docx", bytearray(word(body))), ("/x/b.docx", bytearray(docx.OLE)), ("/x/c.docx", bytearray(b"junk"))], "path string, content binary")
    got = {r["path"]: r for r in docx.extract(df).collect()}
    pages = got["/x/a.docx"]["pages"]
    assert [b["kind"] for b in pages[0]["blocks"]] == ["heading", "paragraph", "paragraph"] and pages[0]["blocks"][2]["text"] == "keptnext page"
    assert pages[1]["blocks"][0]["text"] == "| a | b |\n| --- | --- |\n| c | d |"
    assert got["/x/b.docx"]["status"] == "unsupported" and got["/x/c.docx"]["status"] == "failed"


def test_word_pages():
    run = "<w:p>{}</w:p>"
    text = "<w:r><w:t>{}</w:t></w:r>"
    turned, recorded = '<w:r><w:br w:type="page"/></w:r>', "<w:r><w:lastRenderedPageBreak/></w:r>"
    section = '<w:pPr><w:sectPr><w:type w:val="{}"/></w:sectPr></w:pPr>'
    body = run.format(text.format("A first paragraph that is long enough")) + run.format(recorded + text.format("opens page two, and goes o") + recorded + text.format("n on page three"))
    body += run.format(text.format("is on page three")) + run.format(turned) + run.format(section.format("nextPage") + text.format("page four ends")) + run.format(section.format("continuous") + text.format("page five")) + run.format("<w:pPr><w:outlineLvl w:val='x'/></w:pPr>" + text.format("still five"))
    body += run.format("<w:r><w:t>更换</w:t><w:cr/><w:t>滤芯</w:t><w:br/><w:t>so</w:t><w:softHyphen/><w:t>ft</w:t><w:noBreakHyphen/><w:t>er</w:t><w:br w:type='column'/></w:r>")
    pages = docx.read(word(body))[1]
    got = [[b["text"] for b in p["blocks"]] for p in pages]
    assert got == [["A first paragraph that is long enough"], ["opens page two, and goes on on page three"], ["is on page three"], ["page four ends"], ["page five", "still five", "更换滤芯 soft-er"]]


def test_discovery_and_incremental_index(spark, tmp_path):
    from lexmere.streaming import indexing

    for p, data in {"users/u1/a.docx": word(para("Some text that is long enough.")), "users/u1/b.docx": word(para("Some text that is long enough.")), "users/u1/.c.docx": b"x", "__MACOSX/users/d.docx": b"x", "users/u2/e.docx": b"junk"}.items():
        (tmp_path / "in" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / p).write_bytes(data)
    root = str(tmp_path / "in")
    found = files.discover(spark, root)
    assert found.count() == 3
    snaps = indexing.Snapshots(spark, str(tmp_path / "manifest"), indexing.RECORD)
    assert indexing.start(spark, root, snaps, str(tmp_path / "cp")).awaitTermination(180)
    rows = {r["filename"]: r for r in snaps.read().collect()}
    assert set(rows) == {"a.docx", "e.docx"} and len(rows["a.docx"]["alt_filepaths"]) == 1
    assert rows["a.docx"]["status"] == "indexed" and rows["e.docx"]["status"] == "failed"
    assert indexing.index_files(found, snaps.read(), root).select("filename").collect()[0][0] == "e.docx"
    # a file that moves keeps its document; one that is gone takes its record along
    (tmp_path / "in/users/u1/a.docx").rename(tmp_path / "in/users/u1/moved.docx")
    (tmp_path / "in/users/u1/b.docx").unlink()
    (tmp_path / "in/users/u2/e.docx").unlink()
    before = snaps.read()
    assert indexing.start(spark, root, snaps, str(tmp_path / "cp")).awaitTermination(180)
    indexing.sweep(snaps, files.discover(spark, root).select("path"))
    rows = snaps.read().collect()
    assert [(r["document_id"], r["filepath"].split("/")[-1], r["alt_filepaths"]) for r in rows] == [(rows[0]["document_id"], "moved.docx", [])]
    assert [r["new"].split("/")[-1] for r in manifest.relocated(before, snaps.read()).collect()] == ["moved.docx"]


def test_snapshots_of_two_writers(spark, tmp_path):
    from lexmere.streaming import indexing

    schema = "document_id string, n long"
    one, two = (indexing.Snapshots(spark, str(tmp_path / "t"), schema, buckets=4) for _ in range(2))
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert one.merge(rows(("a", 1), ("b", 1), ("c", 1))) == 1
    base = two.current()
    one.merge(rows(("a", 2)))
    with pytest.raises(indexing.Conflict):
        two.commit(rows(("b", 9)), base)
    assert two.merge(rows(("b", 3), ("d", 3))) == 3
    assert sorted(map(tuple, one.read().collect())) == [("a", 2), ("b", 3), ("c", 1), ("d", 3)]
    assert sorted(map(tuple, one.read(1).collect())) == [("a", 1), ("b", 1), ("c", 1)]
    # a writer that dies before it publishes leaves the table as it was
    (tmp_path / "t/data/4-half/bucket=0").mkdir(parents=True)
    assert one.current() == 3 and one.read().count() == 4


def test_adoption_merges_what_the_new_owner_has(spark):
    from lexmere.functions.ids import document_id

    schema = "document_id string, file_hash string, owner_id string, visibility string, filepath string, alt_filepaths array<string>"
    raw = spark.createDataFrame([("", "h1", "u1", "public", "/1/a", ["/1/b"]), ("", "h2", "u1", "public", "/1/c", []), ("", "h1", "u2", "public", "/2/a", ["/1/b"]), ("", "h3", "u3", "public", "/3/x", [])], schema)
    docs = raw.withColumn("document_id", document_id(F.col("owner_id"), F.col("file_hash")))
    passages = docs.select("document_id", "owner_id", "visibility", F.lit(0).alias("chunk_index"), F.array(F.lit(1.0)).alias("embedding"))
    kept, rows = manifest.adopted(docs, passages, "u1", "u2")
    got = {(r["file_hash"], r["owner_id"]): (r["visibility"], r["filepath"], r["alt_filepaths"]) for r in kept.collect()}
    assert got == {("h1", "u2"): ("public", "/2/a", ["/1/b", "/1/a"]), ("h2", "u2"): ("private", "/1/c", []), ("h3", "u3"): ("public", "/3/x", [])}
    assert {(r["document_id"], r["owner_id"], r["visibility"]) for r in rows.collect()} == {(r["document_id"], r["owner_id"], r["visibility"]) for r in kept.collect()}


def test_streams(spark, tmp_path):
    from lexmere.streaming import answers
    from lexmere.streaming import temporal as live

    src = str(tmp_path / "tokens")
    rows = [("q", 1, 1, "en", "<think>x</think>", False), ("q", 2, 1, "en", "한국어입니다. 그렇습니다. ", False), ("q", 3, 2, "en", "An answer. It is. ", False), ("q", 4, 2, "en", "More", True)]
    spark.createDataFrame(rows, "ask_id string, seq long, attempt int, language string, text string, final boolean").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    assert answers.gated(stream).writeStream.format("memory").queryName("gated").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["seq"], r["name"], r["text"]) for r in spark.table("gated").orderBy("seq", "name").collect()] == [(2, "restart", ""), (3, "delta", "An answer. It is. "), (4, "delta", "More"), (4, "done", "")]
    timed = [("t", k, 1, "en", x, k == 3, f"2024-01-01 00:00:0{k}") for k, x in enumerate(["1. ", "Then a first ", "sentence ends. ", "So"])]
    later = str(tmp_path / "timed")
    spark.createDataFrame(timed, "ask_id string, seq long, attempt int, language string, text string, final boolean, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(later)
    stream = spark.readStream.schema(spark.read.parquet(later).schema).parquet(later)
    assert answers.gated(stream, "at").writeStream.format("memory").queryName("timed").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["seq"], r["name"], r["text"]) for r in spark.table("timed").orderBy("seq", "name").collect()] == [(1, "delta", "1. Then a first "), (2, "delta", "sentence ends. "), (3, "delta", "So"), (3, "done", "")]
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events*.parquet")
    assert live.throttled(events, 5, 86_400).writeStream.format("memory").queryName("throttled").trigger(availableNow=True).start().awaitTermination(120)
    batch = temporal.throttle(spark.read.parquet(f"{SF}/events.parquet"), 5, 86_400)
    columns = ["event_id", "in_window", "allowed"]
    assert sorted(map(tuple, spark.table("throttled").select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert live.sessions(events).isStreaming


def test_layout(spark):
    lines = [("d", p, 0, f"Manual {p}", 5.0, 10.0, 10.0, 20.0, 12.0, 1000.0, 9.0, False, False, False) for p in (1, 2, 3)]
    lines += [("d", 1, 1, "A sentence that goes", 100.0, 50.0, 50.0, 112.0, 12.0, 1000.0, 10.0, False, False, False), ("d", 1, 2, "on here and is mainte-", 114.0, 50.0, 50.0, 126.0, 12.0, 1000.0, 10.0, False, False, False), ("d", 2, 1, "nance of it.", 100.0, 50.0, 50.0, 112.0, 12.0, 1000.0, 10.0, False, False, False)]
    r = spark.createDataFrame(lines, "doc string, page int, order int, text string, top double, left double, first_left double, bottom double, line_height double, page_height double, size double, bold boolean, monospace boolean, trailing_space boolean")
    body = layout.without_margins(r)
    assert body.count() == 3 and layout.body_sizes(r).first()["body_size"] == 10.0
    texts = [x["text"] for x in layout.across_pages(layout.paragraphs(body)).orderBy("page").collect()]
    assert texts == ["A sentence that goes on here and is maintenance", "of it."]


def test_viewer(spark):
    text, source = viewer.folded("Ｈello 更换 滤芯 main-\n tenance  x")
    assert text == "hello 更换滤芯 maintenance x" and len(text) == len(source)
    assert viewer.find(text, "nothing of this is here at all") == ([], 0.0)
    assert viewer.nearest("ab ab ab", "ab", 4) == 3
    rows = spark.createDataFrame([("k", "Before. The filter is replaced yearly. After.", "The filter is\nreplaced yearly.", 0)], "key string, haystack string, passage string, near int")
    got = viewer.find_passages(rows).first()
    assert got["coverage"] == 1.0 and got["ranges"][0]["start"] == 8
