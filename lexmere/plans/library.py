"""Index and clustered search, catalogue, locale order, page layout, uploads, deletion, previews, settings and what readers may see."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import access, catalogue, clustered, layout, manifest, rag, search, temporal, vector_index, word_tables
from ..operators.access import Scope
from ..sources import files
from . import derived as d
from .catalog import ORACLE_SQL, query, table
from .retrieval import _every

_U = d.USERS


def _index(spark, sf):
    p = d.passages(spark, sf)
    lists = max(1, min(vector_index.MOST_LISTS, int(p.count() ** 0.5)))
    return vector_index.build(p, lists)


@query(ORACLE_SQL["vector_topk_scoped"])
def vector_index_scoped(spark, sf):
    found, _ = vector_index.search(_index(spark, sf), _every(spark, sf), 10, scope=Scope("src1"))
    return found.join(d.passages(spark, sf).select("document_id", "chunk_index", "vec_id"), ["document_id", "chunk_index"]).select("query_id", "rank", "vec_id", "document_id", "chunk_index", "score")


@query(ORACLE_SQL["vector_topk_filtered"])
def vector_index_filtered(spark, sf):
    found, _ = vector_index.search(_index(spark, sf), _every(spark, sf), 10, {"language": "en"})
    return found.join(d.passages(spark, sf).select("document_id", "chunk_index", "vec_id"), ["document_id", "chunk_index"]).select("query_id", "rank", "vec_id", "document_id", "chunk_index", "score")


@query(d.with_(d.PASSAGES) + "SELECT vec_id, document_id, chunk_index FROM passages WHERE owner_id = 'src2' AND language = 'en'")
def clustered_passages(spark, sf):
    path = clustered.write(d.passages(spark, sf), 32)
    return clustered.read(spark, path, {"owner_id": "src2", "language": "en"}).select("vec_id", "document_id", "chunk_index")


_GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _views(spark, sf):
    for name in _GIVEN:
        table(spark, sf, name).createOrReplaceTempView(f"given_{name}")
    return [f"given_{n}" for n in (*_GIVEN, "nothing")]


@query(
    " UNION ALL ".join(f"SELECT 'given_{n}' AS name, true AS present, (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{n}') AS n_columns, (SELECT count(*) FROM {n}) AS rows" for n in _GIVEN)
    + " UNION ALL SELECT 'given_nothing', false, NULL, NULL"
)
def catalogue_tables(spark, sf):
    return catalogue.describe(spark, _views(spark, sf)).select("name", "present", "n_columns", "rows")


@query("SELECT 'given_' || table_name AS name, CAST(column_index AS INTEGER) AS position, column_name AS \"column\" FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{n}'" for n in _GIVEN) + ")")
def catalogue_columns(spark, sf):
    return catalogue.columns(spark, _views(spark, sf)).select("name", "position", "column")


@query("SELECT 'given_embeddings' AS name, true AS present, count(*) AS points, CAST(max(len(embedding)) AS INTEGER) AS dimension, min(coalesce(len(embedding), -1)) = max(coalesce(len(embedding), -1)) AS even FROM embeddings UNION ALL SELECT 'given_nothing', false, NULL, NULL, NULL")
def collection_status(spark, sf):
    _views(spark, sf)
    return catalogue.collection_status(spark, "given_embeddings").unionByName(catalogue.collection_status(spark, "given_nothing"))


_WORDS = "w AS (SELECT DISTINCT regexp_extract(text, '^[^\\s.,;:!?|#$%&*()0-9]+') AS word FROM documents WHERE text IS NOT NULL)"


@query(d.with_(_WORDS) + "SELECT word, row_number() OVER (ORDER BY word COLLATE de.NOCASE, word) AS place FROM w WHERE length(word) >= 2 AND regexp_matches(word, '^[A-Za-z]+$')")
def names_by_locale(spark, sf):
    """Names in a reader's order, upper and lower case alike; ties by code point."""
    word = F.regexp_extract("text", r"^[^\s.,;:!?|#$%&*()0-9]+", 0).alias("word")
    w = table(spark, sf, "documents").where("text IS NOT NULL").select(word).distinct().where("length(word) >= 2 AND word RLIKE '^[A-Za-z]+$'")
    return manifest.numbered(w, *manifest.by_locale("word"))


# regions of a page for each order: its lines, one below the other, more or less near
_REGIONS = """r AS (SELECT l_orderkey AS doc, 1 AS page, l_linenumber AS "order", l_linenumber * 20.0 + l_quantity % 5 AS top, l_linenumber * 20.0 + l_quantity % 5 + 12 + l_partkey % 4 AS bottom, 50.0 + l_suppkey % 4 * 3 AS "left",
    50.0 + l_suppkey % 4 * 3 + l_partkey % 2 * 4 AS first_left, 10.0 + l_linenumber % 2 * 3 AS line_height, CASE l_returnflag WHEN 'R' THEN 'it ends here.' WHEN 'A' THEN 'it goes on' ELSE 'and on it' END AS text, l_shipmode_ = 0 AS monospace
    FROM (SELECT *, l_partkey % 9 AS l_shipmode_ FROM lineitem))"""


def _regions(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc", "1 AS page", "l_linenumber AS `order`", "l_linenumber * 20.0D + l_quantity % 5 AS top", "l_linenumber * 20.0D + l_quantity % 5 + 12 + l_partkey % 4 AS bottom", "50.0D + l_suppkey % 4 * 3 AS left",
        "50.0D + l_suppkey % 4 * 3 + l_partkey % 2 * 4 AS first_left", "10.0D + l_linenumber % 2 * 3 AS line_height", "CASE l_returnflag WHEN 'R' THEN 'it ends here.' WHEN 'A' THEN 'it goes on' ELSE 'and on it' END AS text", "l_partkey % 9 = 0 AS monospace",
    )


@query(
    d.recursive(
        _REGIONS,
        """o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(top, 1), first_left, "order", top, bottom, "left", line_height, NOT monospace, text LIKE '%.') AS i FROM r)""",
        """f AS (SELECT doc, i, "order", 1 AS paragraph, "left" AS edge, bottom, line_height, text, monospace FROM o WHERE i = 1
        UNION ALL SELECT o.doc, o.i, o."order", CASE WHEN g THEN paragraph ELSE paragraph + 1 END, CASE WHEN g THEN least(edge, o."left") ELSE o."left" END, o.bottom, o.line_height, o.text, o.monospace
        FROM (SELECT f.doc AS d, f.i AS j, f.paragraph, f.edge, o.*, NOT f.monospace AND NOT o.monospace AND abs(o.first_left - f.edge) <= 5 AND o.top - f.bottom >= 0 AND o.top - f.bottom <= 0.6 * f.line_height AND f.text NOT LIKE '%.' AS g
            FROM f JOIN o ON o.doc = f.doc AND o.i = f.i + 1) o)""",
    )
    + 'SELECT doc, "order", CAST(paragraph AS INTEGER) AS paragraph FROM f'
)
def page_continuations(spark, sf):
    return layout.continuations(_regions(spark, sf), 10.0).select("doc", F.col("order"), "paragraph")


def _words(spark, sf):
    """Word boxes: each nation's suppliers as lines of a page, with a name, a place and a balance of two words; a sentence far below."""
    s = table(spark, sf, "supplier").withColumn("i", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    low = lambda x: f"i * 14.0D + s_suppkey % 3 {x}"
    boxes = [("s_name", 50, 150), ("concat('n', s_nationkey)", 190, 215), ("'about'", 300, 330), ("CAST(CAST(round(s_acctbal) AS BIGINT) AS STRING)", 333, 360)]
    parts = [s.selectExpr("s_nationkey AS doc", "1 AS page", f"{t} AS text", f"{a}.0D AS left", low("") + " AS top", f"{b}.0D AS right", low("+ 9") + " AS bottom") for t, a, b in boxes]
    below = s.groupBy("s_nationkey").agg(F.max("i").alias("i")).selectExpr("s_nationkey AS doc", "1 AS page", "'Prices as of today' AS text", "50.0D AS left", "i * 14.0D + 100 AS top", "200.0D AS right", "i * 14.0D + 109 AS bottom")
    out = below
    for p in parts:
        out = out.unionByName(p)
    return out


_LINES = "l AS (SELECT s_nationkey, s_suppkey, '| ' || s_name || ' | n' || s_nationkey || ' | about ' || CAST(round(s_acctbal) AS BIGINT) || ' |' AS line, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)"


@query(
    d.with_(_LINES)
    + """SELECT s_nationkey AS doc, count(*) AS n_rows, CAST(3 AS INTEGER) AS n_columns, string_agg(CASE WHEN i = 1 THEN line || chr(10) || '| --- | --- | --- |' ELSE line END, chr(10) ORDER BY i) AS markdown
    FROM l GROUP BY s_nationkey HAVING count(*) >= 2"""
)
def page_tables(spark, sf):
    return word_tables.tables(_words(spark, sf)).select("doc", "n_rows", "n_columns", "markdown")


@query("SELECT s_nationkey AS doc, 'Prices as of today' AS text FROM supplier GROUP BY s_nationkey HAVING count(*) >= 2 UNION ALL SELECT s_nationkey, 'Prices as of today' FROM supplier GROUP BY s_nationkey HAVING count(*) < 2")
def page_text_outside_tables(spark, sf):
    """Every word stands in its page's table but the sentence below it."""
    w = _words(spark, sf)
    many = w.groupBy("doc").agg(F.count("*").alias("n")).where("n > 5").select("doc")
    few = w.join(many, "doc", "left_anti").where("text LIKE 'Prices%'")
    return word_tables.outside(w.join(many, "doc", "left_semi"), word_tables.tables(w)).unionByName(few.select(*w.columns)).select("doc", "text")


_UPLOADS = """u AS (SELECT c_nationkey AS batch, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place, 'f' || (c_custkey % 7) || '.pdf' AS name FROM customer),
    n AS (SELECT batch, count(*) AS n FROM u GROUP BY batch)"""


@query(
    d.with_(_UPLOADS)
    + """, t AS (SELECT *, name IN ('f0.pdf', 'f3.pdf') AND row_number() OVER (PARTITION BY batch, name ORDER BY place) = 1 AS refused FROM u),
    k AS (SELECT t.*, n.n, CASE WHEN NOT refused THEN row_number() OVER (PARTITION BY t.batch, refused ORDER BY place) END AS p FROM t JOIN n ON n.batch = t.batch)
    SELECT batch, place, CASE WHEN p <= n - 4 THEN 'saved ' || p ELSE name END AS name, CASE WHEN p <= n - 4 THEN 'waiting' ELSE 'rejected' END AS state,
        CASE WHEN refused AND name = 'f0.pdf' THEN 'too large' WHEN refused THEN 'not a PDF' WHEN p > n - 4 THEN 'not saved' END AS error, CASE WHEN p <= n - 4 THEN batch || '/' || p END AS file_id FROM k"""
)
def upload_outcomes(spark, sf):
    """Uploads of repeated names: two names are refused once, one of them for two reasons; the store keeps all but four."""
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_nationkey").alias("batch"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long").alias("place"), F.concat(F.lit("f"), (F.col("c_custkey") % 7).cast("string"), F.lit(".pdf")).alias("name"))
    sizes = rows.groupBy("batch").agg(F.count("*").alias("n"))
    refused = sizes.select("batch", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(n).alias("name"), F.lit(r).alias("reason")) for p, n, r in ((1, "f0.pdf", "empty"), (2, "f3.pdf", "not a PDF"), (3, "f0.pdf", "too large"))])).alias("x")).select("batch", "x.*")
    saved = sizes.where("n > 4").select("batch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 4)).alias("place"))
    saved = saved.select("batch", "place", F.concat(F.lit("saved "), F.col("place").cast("string")).alias("name"), F.concat_ws("/", F.col("batch").cast("string"), F.col("place").cast("string")).alias("file_id"))
    return manifest.settled_uploads(rows, refused, saved).select("batch", "place", "name", "state", "error", "file_id")


@query(
    d.with_(d.MANIFEST, _U)
    + """, t AS (SELECT 'users' AS t, count(*) FILTER (WHERE user_id = 'u2') AS a, count(*) FILTER (WHERE user_id <> 'u2') AS b FROM users UNION ALL SELECT 'documents', count(*) FILTER (WHERE owner_id = 'u2'), count(*) FILTER (WHERE owner_id <> 'u2') FROM manifest
    UNION ALL SELECT 'passages', CAST(coalesce(sum(chunks) FILTER (WHERE owner_id = 'u2'), 0) AS BIGINT), CAST(sum(chunks) FILTER (WHERE owner_id <> 'u2') AS BIGINT) FROM manifest UNION ALL SELECT 'files', count(*) FILTER (WHERE owner_id = 'u2'), count(*) FILTER (WHERE owner_id <> 'u2') FROM manifest WHERE status <> 'failed')
    SELECT t AS "table", a AS removed, b AS "left" FROM t"""
)
def user_deletion(spark, sf):
    m = d.manifest(spark, sf)
    passages = m.select("document_id", "owner_id", F.explode(F.sequence(F.lit(1), F.col("chunks"))).alias("chunk_index"))
    return manifest.without_user("u2", d.users(spark, sf), m, passages, m.where("status <> 'failed'").select("filepath", "owner_id"))[1]


@query(
    d.with_(d.MANIFEST, _U)
    + """SELECT chunk.doc_id, n FROM (SELECT doc_id, unnest(range(1, chunks + 1)) AS n FROM manifest WHERE owner_id <> 'u2') chunk"""
)
def user_deletion_passages(spark, sf):
    """The passages that stay."""
    m = d.manifest(spark, sf)
    passages = m.select("doc_id", "owner_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("chunks").cast("long"))).alias("n"))
    return manifest.without_user("u2", d.users(spark, sf), m, passages, m)[0]["passages"].select("doc_id", "n")


@query(
    d.with_(d.MANIFEST, _U)
    + """, m AS (SELECT doc_id, owner_id, 'u' || (min(doc_id) OVER (PARTITION BY document_id) % 31) AS publisher FROM manifest WHERE visibility = 'public')
    SELECT doc_id, publisher, p.username AS publisher_name, o.username AS owner_name FROM m LEFT JOIN users p ON p.user_id = publisher LEFT JOIN users o ON o.user_id = m.owner_id"""
)
def publisher_names(spark, sf):
    m = d.manifest(spark, sf)
    publishers = m.where("visibility = 'public'").groupBy("document_id").agg(F.concat(F.lit("u"), (F.min("doc_id") % 31).cast("string")).alias("publisher"))
    return access.published(m.where("visibility = 'public'"), publishers, d.users(spark, sf)).select("doc_id", "publisher", "publisher_name", "owner_name")


@query(
    d.with_(_U)
    + """, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'signup')
    SELECT event_id, u.user_id, username, row_number() OVER (ORDER BY ts, event_id) AS place FROM q JOIN users u ON u.user_id = 'u' || q.user_id WHERE n = 1 AND TIMESTAMP '2024-01-31' - ts < INTERVAL 20 DAY"""
)
def pending_requests(spark, sf):
    """Requests that wait for an administrator, with their users' names, oldest first."""
    states = temporal.request_states(table(spark, sf, "events").where("event_type = 'signup'"), "2024-01-31", 20 * 86_400).where("state = 'pending'")
    named = states.withColumn("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string"))).join(d.users(spark, sf), "user_id")
    return named.select("event_id", "user_id", "username", F.row_number().over(Window.orderBy("ts", "event_id")).cast("long").alias("place"))


@query(d.with_(_U) + ", q AS (SELECT count(DISTINCT user_id) AS n FROM events WHERE event_type = 'signup') SELECT count(*) FILTER (WHERE is_admin) AS admins, count(*) > 0 AS any_user, (SELECT n FROM q) AS waiting FROM users")
def account_counts(spark, sf):
    waiting = table(spark, sf, "events").where("event_type = 'signup'").agg(F.countDistinct("user_id").alias("waiting"))
    return d.users(spark, sf).agg(F.count_if("is_admin").alias("admins"), (F.count("*") > 0).alias("any_user")).crossJoin(waiting)


_TEXTS = "t AS (SELECT doc_id, text, sha256(text) AS now, CASE WHEN doc_id % 4 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS was FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"


@query(
    d.with_(_TEXTS)
    + """SELECT doc_id, CAST(greatest(ceil(length(text) / 1000), 1) AS INTEGER) AS total_pages, CASE WHEN doc_id % 9 <> 0 THEN now = was END AS hash_matches,
    CAST(least(greatest(greatest(ceil(length(text) / 1000), 1) - 2, 0), 3) AS INTEGER) AS pages, sha256(substr(text, 2001, 3000)) AS shown FROM t"""
)
def extraction_preview(spark, sf):
    """Pages 3 to 5 of each document extracted again, and whether its content is the one that was indexed."""
    t = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    n = F.greatest(F.ceil(F.length("text") / 1000).cast("int"), F.lit(1))
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * 1000 + 1, F.lit(1000)))
    found = t.select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("file_hash"), pages.alias("pages"))
    known = t.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("document_id"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("file_hash"))
    shown = manifest.preview(found, known, 2, 3)
    return shown.select(F.col("document_id").alias("doc_id"), "total_pages", "hash_matches", F.size("shown").alias("pages"), F.sha2(F.array_join("shown", ""), 256).alias("shown"))


@query("SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 10 ELSE CAST(props::JSON ->> 'k' AS BIGINT) END AS top_k FROM events")
def setting_values(spark, sf):
    """Settings as JSON: one value from each event's properties, or the default where they are no JSON."""
    e = table(spark, sf, "events")
    broken = F.when(F.col("event_id") % 3 == 0, F.substring("props", 2, 100)).otherwise(F.col("props"))
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), F.coalesce(F.try_variant_get(F.try_parse_json(broken), "$.k", "long"), F.lit(10).cast("long")).alias("top_k"))


_RUNS = "runs AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS processed, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY ALL)"


@query(
    d.with_(_RUNS)
    + "SELECT user_id, day, processed, user_id % 4 = 1 AS is_mine, CASE WHEN user_id % 4 = 1 THEN 'u1' END AS started_by, CASE WHEN user_id % 4 = 1 THEN '/d/' || user_id END AS directory, CASE WHEN user_id % 4 = 1 THEN failures END AS failures FROM runs"
)
def jobs_of_readers(spark, sf):
    e = table(spark, sf, "events")
    runs = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "error").alias("failures"))
    runs = runs.withColumns({"started_by": F.when(F.col("user_id") % 7 != 5, F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).otherwise(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))), "directory": F.concat(F.lit("/d/"), F.col("user_id").cast("string"))})
    return access.masked_jobs(runs, "u1", False).select("user_id", "day", "processed", "is_mine", "started_by", "directory", "failures")


@query(
    """SELECT query FROM (SELECT arg_max(query, (ts, event_id)) AS query, max((ts, event_id)) AS newest FROM (SELECT event_id, ts, upper(event_type) || ' ' || (event_id % 5) AS query FROM events) WHERE contains(lower(query), 'click') AND lower(query) <> 'click 3' GROUP BY lower(query)) ORDER BY newest DESC LIMIT 8"""
)
def search_suggestions(spark, sf):
    s = table(spark, sf, "events").select("event_id", "ts", F.concat_ws(" ", F.upper("event_type"), (F.col("event_id") % 5).cast("string")).alias("query"))
    return manifest.suggestions(s.where("lower(query) <> 'click 3'"), "Click")


@query("SELECT c_custkey, length(substr(c_name, 1, CAST(c_custkey % 17 AS INTEGER))) BETWEEN 8 AND 128 AS valid FROM customer")
def valid_passwords(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", access.valid_password(F.substring("c_name", F.lit(1), (F.col("c_custkey") % 17).cast("int"))).alias("valid"))


@query(
    ORACLE_SQL["file_states"].replace("SELECT filepath AS path,", "SELECT count(*) FILTER (WHERE state IN ('queued', 'not_indexed')) AS waiting, count(*) FILTER (WHERE state = 'processing') AS processing, count(*) FILTER (WHERE state = 'indexed') AS done, count(*) FILTER (WHERE state IN ('failed', 'unsupported')) AS failed FROM (SELECT filepath AS path,")
    + ")"
)
def upload_panel(spark, sf):
    m = d.manifest(spark, sf).withColumnRenamed("filepath", "path")
    return manifest.panel(manifest.file_states(m.select("path"), m.where("doc_id % 3 <> 1"), m.where("doc_id % 19 = 0"), m.where("doc_id % 11 = 0")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS run FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY run ORDER BY event_id) <= 50")
def failures_kept(spark, sf):
    failures = table(spark, sf, "events").where("event_type = 'error'").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("run"))
    return manifest.kept_failures(failures, place="event_id")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'too large' WHEN doc_id % 5 = 4 THEN 'empty' WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN 'not a PDF' WHEN doc_id % 2 = 1 AND doc_id % 3 = 1 THEN 'an old or encrypted Word file' WHEN doc_id % 2 = 1 AND doc_id % 3 = 2 THEN 'not a Word file' END AS reason
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"""
)
def upload_rejections(spark, sf):
    """Uploads judged by size and first bytes: every other one is a PDF by name."""
    t = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    head = F.expr("CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN X'255044462D' ELSE X'00' END ELSE CASE doc_id % 3 WHEN 0 THEN X'504B0304' WHEN 1 THEN X'D0CF11E0A1B11AE1' ELSE X'00' END END")
    size = F.expr("CASE WHEN doc_id % 11 = 0 THEN 300000000 WHEN doc_id % 5 = 4 THEN 0 ELSE 100 END")
    u = t.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a.pdf").otherwise("a.docx").alias("filename"), F.concat(head, F.encode("text", "UTF-8")).alias("content"), size.alias("length"))
    return u.select("doc_id", files.reject_reason(u).alias("reason"))


@query(d.with_(d.MANIFEST) + "SELECT filepath AS path, true AS found FROM manifest WHERE doc_id % 3 = 0 UNION ALL SELECT filepath || '.gone', false FROM manifest WHERE doc_id % 5 = 0")
def requested_files(spark, sf):
    """An explicit list of files: those that are there, and those that are not."""
    m = d.manifest(spark, sf)
    asked = m.where("doc_id % 3 = 0").selectExpr("filepath AS path").unionByName(m.where("doc_id % 5 = 0").selectExpr("concat(filepath, '.gone') AS path")).unionByName(m.where("doc_id % 3 = 0").selectExpr("filepath AS path"))
    there, absent = files.listed(m.selectExpr("filepath AS path"), asked)
    return there.select("path", F.lit(True).alias("found")).unionByName(absent.select("path", F.lit(False).alias("found")))


@query(d.with_(d.MANIFEST) + "SELECT doc_id, owner_id, 'library' AS tree, CAST(0 AS INTEGER) AS version FROM manifest")
def added_columns(spark, sf):
    m = d.manifest(spark, sf).select("doc_id", "owner_id")
    return manifest.add_missing_columns(m, {"owner_id": F.lit("nobody"), "tree": F.lit("library"), "version": F.lit(0)})


@query(
    """SELECT doc_id, round(list_sum(list_transform(range(0, 48), lambda i: (i + 1) * v[i + 1])) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS weighed
    FROM (SELECT doc_id, list_transform(range(0, 48), lambda i: CAST('0x' || substr(h, CAST(i % 32 * 2 + 1 AS INTEGER), 2) AS INTEGER) / 255.0::DOUBLE) AS v FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL))"""
)
def stand_in_vectors(spark, sf):
    v = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", ids.hash_embedding(F.col("text"), 48).alias("v"))
    return v.select("doc_id", F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighed"))


@query(
    """SELECT l_orderkey, l_linenumber, length(t) <= 120 AND s >= 1.15 * 10 OR (b AND length(t) <= 80 AND t NOT LIKE '%.') AS heading
    FROM (SELECT l_orderkey, l_linenumber, 'Chapter ' || l_partkey || CASE WHEN l_returnflag = 'R' THEN '.' ELSE '' END || CASE WHEN l_linestatus = 'O' THEN repeat(' and on', CAST(l_quantity AS INTEGER)) ELSE '' END AS t, l_discount * 200 AS s, l_suppkey % 2 = 0 AS b FROM lineitem)"""
)
def page_headings(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('Chapter ', l_partkey, CASE WHEN l_returnflag = 'R' THEN '.' ELSE '' END, CASE WHEN l_linestatus = 'O' THEN repeat(' and on', CAST(l_quantity AS INT)) ELSE '' END) AS t", "l_discount * 200 AS s", "l_suppkey % 2 = 0 AS b")
    return x.select("l_orderkey", "l_linenumber", text.is_heading(F.col("t"), F.col("s"), F.lit(10.0), F.col("b")).alias("heading"))


@query(
    ORACLE_SQL["rerank_topn"].split("SELECT ask_id, place, document_id, rerank FROM ranked")[0].rstrip()
    + """, g AS (SELECT ask_id, bool_or(rank % 5 = 4) AS broken FROM few GROUP BY ask_id)
    SELECT f.ask_id, CAST(row_number() OVER (PARTITION BY f.ask_id ORDER BY CASE WHEN broken THEN NULL ELSE rerank END DESC NULLS LAST, rank) AS INTEGER) AS place, document_id, CASE WHEN NOT broken THEN rerank END AS rerank FROM few f JOIN g ON g.ask_id = f.ask_id"""
)
def rerank_or_search_order(spark, sf):
    """A question whose reranker fails on any hit keeps the search's order, without scores."""
    score = F.when(F.col("rank") % 5 != 4, ids.overlap_score(F.col("question"), F.col("text")))
    return rag.rerank_or_search(d.hits(spark, sf), 6, score).select("ask_id", "place", "document_id", "rerank")


# some files failed; of the rest, every paragraph with a letter is a passage
_PARTS = "CASE WHEN doc_id % 9 = 4 THEN '12 - 3' ELSE text END"


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN n = 0 THEN 'unsupported' ELSE 'indexed' END AS status, CASE WHEN doc_id % 17 = 0 THEN 'broken file' WHEN n = 0 THEN 'no passages' END AS error_message, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n END AS chunks
    FROM (SELECT doc_id, coalesce(len(list_filter(string_split({_PARTS}, chr(10)), lambda x: regexp_matches(x, '\\p{{L}}'))), 0) AS n FROM documents WHERE doc_id IS NOT NULL)"""
)
def extraction_outcomes(spark, sf):
    t = table(spark, sf, "documents").where("doc_id IS NOT NULL")
    failed = F.col("doc_id") % 17 == 0
    extracted = t.select(F.col("doc_id").alias("document_id"), F.when(failed, "failed").otherwise("extracted").alias("status"), F.when(failed, "broken file").alias("error_message"))
    passages = t.select(F.col("doc_id").alias("document_id"), F.explode(F.split(F.expr(_PARTS), "\n", -1)).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    return manifest.settled(extracted, passages).select(F.col("document_id").alias("doc_id"), "status", "error_message", "chunks")
