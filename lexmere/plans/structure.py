"""Trees, time, document structure and passages."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking, layout, temporal, tree
from . import derived as d
from .catalog import query, table

_TREE = d.recursive(d.FOLDERS, d.FILES)
_PATHS = """, t AS (SELECT folder_id, parent_id, name, 1 AS depth, '/' || name AS path FROM folders WHERE parent_id IS NULL
    UNION ALL SELECT f.folder_id, f.parent_id, f.name, t.depth + 1, t.path || '/' || f.name FROM folders f JOIN t ON f.parent_id = t.folder_id)\n"""
_BELOW = """, s AS (SELECT folder_id, 0 AS level FROM folders WHERE folder_id = 'r1' UNION ALL SELECT f.folder_id, s.level + 1 FROM folders f JOIN s ON f.parent_id = s.folder_id)\n"""


@query(_TREE + _PATHS + "SELECT folder_id, parent_id, name, depth, path FROM t")
def tree_paths(spark, sf):
    return tree.paths(d.folders(spark, sf))


@query(_TREE + _BELOW + "SELECT folder_id, level FROM s")
def tree_subtree(spark, sf):
    return tree.subtree(d.folders(spark, sf), "r1")


@query(_TREE + ", a AS (SELECT folder_id, parent_id, name, 0 AS level FROM folders WHERE folder_id = 'c10' UNION ALL SELECT f.folder_id, f.parent_id, f.name, a.level + 1 FROM folders f JOIN a ON f.folder_id = a.parent_id) SELECT folder_id, name, level FROM a")
def tree_ancestors(spark, sf):
    return tree.ancestors(d.folders(spark, sf), "c10")


@query(_TREE + ", h AS (SELECT folder_id AS top, folder_id, 1 AS level FROM folders UNION ALL SELECT h.top, f.folder_id, h.level + 1 FROM folders f JOIN h ON f.parent_id = h.folder_id) SELECT top AS folder_id, max(level) AS height FROM h GROUP BY top")
def tree_height(spark, sf):
    return tree.heights(d.folders(spark, sf))


@query(_TREE + _PATHS + "SELECT x.folder_id, x.path, x.depth, count(f.file_id) AS files FROM (SELECT folder_id, path, depth FROM t UNION ALL SELECT NULL, '/', 0) x LEFT JOIN files f ON f.folder_id IS NOT DISTINCT FROM x.folder_id GROUP BY x.folder_id, x.path, x.depth")
def tree_counts(spark, sf):
    return tree.counted(d.folders(spark, sf), d.files(spark, sf))


@query(_TREE + _BELOW + "SELECT file_id, folder_id, name FROM files WHERE folder_id IN (SELECT folder_id FROM s)")
def files_under_folder(spark, sf):
    return tree.files_under(d.folders(spark, sf), d.files(spark, sf), "r1").select("file_id", "folder_id", "name")


@query(_TREE + _BELOW + "SELECT folder_id FROM folders WHERE folder_id NOT IN (SELECT folder_id FROM s)")
def tree_move_targets(spark, sf):
    return tree.move_targets(d.folders(spark, sf), ["r1"]).select("folder_id")


_SHORT = "CASE WHEN folder_id LIKE 'c%' THEN CASE WHEN length(folder_id) % 2 = 0 THEN upper(substr(name, 1, 17)) ELSE lower(substr(name, 1, 17)) END ELSE name END"


@query(_TREE + f"SELECT folder_id, other_id FROM (SELECT folder_id, min(folder_id) OVER (PARTITION BY parent_id, lower({_SHORT})) AS other_id FROM folders) WHERE folder_id <> other_id")
def sibling_clashes(spark, sf):
    return tree.sibling_clashes(d.folders(spark, sf).withColumn("name", F.expr(_SHORT)))


@query(_TREE + "SELECT folder_id, row_number() OVER (PARTITION BY parent_id ORDER BY lower(name), name, folder_id) AS place FROM folders")
def folders_in_order(spark, sf):
    return tree.in_order(d.folders(spark, sf)).select("folder_id", F.col("place").cast("long").alias("place"))


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(upper(n)), n, s_suppkey) AS place FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'é' WHEN 1 THEN 'É' ELSE 'ß' END || s_name AS n FROM supplier)")
def files_in_order(spark, sf):
    named = table(spark, sf, "supplier").withColumn("n", F.expr("concat(CASE s_suppkey % 3 WHEN 0 THEN 'é' WHEN 1 THEN 'É' ELSE 'ß' END, s_name)"))
    return named.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*tree.file_order("n"), "s_suppkey")).cast("long").alias("place"))


@query(_TREE + "SELECT folder_id, CASE WHEN folder_id = 'n3' THEN 'New name' ELSE name END AS name FROM folders")
def tree_rename(spark, sf):
    return tree.rename(d.folders(spark, sf), "n3", "  New \t name ").select("folder_id", "name")


@query(_TREE + "SELECT file_id, CASE WHEN file_id LIKE '%5' THEN 'r1' ELSE folder_id END AS folder_id FROM files")
def tree_move_files(spark, sf):
    files = d.files(spark, sf)
    return tree.move_files(d.folders(spark, sf), files, files.where("file_id LIKE '%5'"), "r1").select("file_id", "folder_id")


_PLACED = ", p AS (SELECT '/d/' || file_id AS path, folder_id, CASE WHEN file_id LIKE '%1' THEN 'u1' ELSE 'u0' END AS tree FROM files)\n"


def _placements(spark, sf):
    return d.files(spark, sf).selectExpr("concat('/d/', file_id) AS path", "folder_id", "CASE WHEN file_id LIKE '%1' THEN 'u1' ELSE 'u0' END AS tree")


@query(_TREE + _PLACED + "SELECT path, CASE WHEN path LIKE '%7' THEN 'r2' ELSE folder_id END AS folder_id FROM p UNION ALL SELECT path || '-new', 'r2' FROM p WHERE path LIKE '%7'")
def tree_place(spark, sf):
    p = _placements(spark, sf)
    own = p.where("path LIKE '%7'")
    fresh = own.unionByName(own.withColumn("path", F.concat("path", F.lit("-new")))).withColumn("folder_id", F.lit("r2"))
    return tree.placed(p, fresh).select("path", "folder_id")


@query(_TREE + _PLACED + "SELECT path, folder_id FROM p WHERE tree <> 'u1' AND path NOT LIKE '%9'")
def tree_forget(spark, sf):
    p = _placements(spark, sf)
    return tree.forgotten(p, p.where("path LIKE '%9'"), "u1").select("path", "folder_id")


@query(
    _TREE + _PLACED
    + """, m AS (SELECT '/d/s' || s_suppkey AS old, CASE WHEN s_suppkey % 2 = 0 THEN '/d/s' || (s_suppkey + 1) ELSE '/new/' || s_suppkey END AS new FROM supplier WHERE s_suppkey % 10 IN (3, 4))
    SELECT coalesce(CASE WHEN t.path IS NULL THEN a.new END, p.path) AS path, CASE WHEN b.old IS NOT NULL THEN o.folder_id ELSE p.folder_id END AS folder_id FROM p LEFT JOIN m a ON a.old = p.path LEFT JOIN p t ON t.path = a.new
    LEFT JOIN m b ON b.new = p.path LEFT JOIN p o ON o.path = b.old WHERE a.old IS NULL OR t.path IS NULL"""
)
def tree_relocate(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 10 IN (3, 4)")
    moves = s.selectExpr("concat('/d/s', s_suppkey) AS old", "CASE WHEN s_suppkey % 2 = 0 THEN concat('/d/s', s_suppkey + 1) ELSE concat('/new/', s_suppkey) END AS new")
    return tree.relocated(_placements(spark, sf), moves).select("path", "folder_id")


_ADOPTED = "f AS (SELECT folder_id, parent_id, name, CASE WHEN folder_id = 'r4' THEN 'u1' ELSE 'u0' END AS tree FROM folders)"


@query(_TREE + _PLACED + f", {_ADOPTED} SELECT path, folder_id FROM p WHERE tree <> 'u1' UNION ALL SELECT '/n' || path, coalesce(folder_id, 'home') FROM p WHERE tree = 'u1' AND path LIKE '%11'")
def tree_adopt_files(spark, sf):
    folders = d.folders(spark, sf).withColumn("tree", F.expr("CASE WHEN folder_id = 'r4' THEN 'u1' ELSE 'u0' END"))
    p = _placements(spark, sf)
    moved = p.where("tree = 'u1' AND path LIKE '%11'").selectExpr("path AS old", "concat('/n', path) AS new")
    return tree.adopt(folders, p, moved, "u1", "u0", "home", "asia")[1].select("path", "folder_id")


@query(_TREE + f", {_ADOPTED} SELECT folder_id, CASE WHEN folder_id = 'r4' THEN 'home' ELSE parent_id END AS parent_id, name, 'u0' AS tree FROM f UNION ALL SELECT 'home', NULL, 'asia (2)', 'u0'")
def tree_adopt(spark, sf):
    folders = d.folders(spark, sf).withColumn("tree", F.expr("CASE WHEN folder_id = 'r4' THEN 'u1' ELSE 'u0' END"))
    p = _placements(spark, sf)
    return tree.adopt(folders, p, p.limit(0).selectExpr("path AS old", "path AS new"), "u1", "u0", "home", "asia")[0]


@query(_TREE + "SELECT folder_id, CASE WHEN folder_id = 'n3' THEN 'r0' ELSE parent_id END AS parent_id FROM folders")
def tree_move(spark, sf):
    return tree.move(d.folders(spark, sf), "n3", "r0").select("folder_id", "parent_id")


@query(_TREE + _BELOW + "SELECT file_id, CASE WHEN folder_id NOT IN (SELECT folder_id FROM s) THEN folder_id END AS folder_id FROM files")
def tree_delete(spark, sf):
    return tree.delete(d.folders(spark, sf), d.files(spark, sf), "r1")[1].select("file_id", "folder_id")


@query(_TREE + "SELECT folder_id, count(*) AS files FROM files GROUP BY folder_id")
def files_per_folder(spark, sf):
    return d.files(spark, sf).groupBy("folder_id").agg(F.count("*").alias("files"))


_DAY = 86_400


@query(
    """SELECT event_id, user_id, n AS in_window, n <= 5 AS allowed FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) AS n FROM events)"""
)
def throttle_sliding(spark, sf):
    return temporal.throttle(table(spark, sf, "events"), 5, _DAY).select("event_id", "user_id", "in_window", "allowed")


_SESSIONS = """s AS (SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS last_seen, count(*) AS events FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY user_id, session)"""


@query(d.with_(_SESSIONS) + "SELECT user_id, session, events FROM s")
def session_idle(spark, sf):
    return temporal.sessions(table(spark, sf, "events"), _DAY).select("user_id", "session", "events")


@query(d.with_(_SESSIONS) + "SELECT user_id, session, events FROM s WHERE started <= TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20' - last_seen < INTERVAL 1 DAY AND TIMESTAMP '2024-01-20' - started < INTERVAL 10 DAY")
def session_live(spark, sf):
    found = temporal.sessions(table(spark, sf, "events"), _DAY)
    return temporal.live_sessions(found, "2024-01-20", _DAY, 10 * _DAY).select("user_id", "session", "events")


@query(
    """SELECT event_id, user_id, CASE WHEN n > 1 THEN 'superseded' WHEN TIMESTAMP '2024-01-31' - ts >= INTERVAL 1 DAY THEN 'expired' ELSE 'pending' END AS state FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'signup')"""
)
def reset_state(spark, sf):
    return temporal.request_states(table(spark, sf, "events").where("event_type = 'signup'"), "2024-01-31", _DAY).select("event_id", "user_id", "state")


@query(
    """SELECT event_id, user_id, CASE WHEN decision IN ('denied', 'completed') THEN decision WHEN decision = 'approved' AND n = 1 AND TIMESTAMP '2024-01-31' - ts < INTERVAL 20 DAY THEN 'approved' WHEN n > 1 THEN 'superseded'
        WHEN TIMESTAMP '2024-01-31' - ts >= INTERVAL 20 DAY THEN 'expired' ELSE 'pending' END AS state FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'denied' WHEN 2 THEN 'completed' END AS decision,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)"""
)
def reset_decisions(spark, sf):
    e = table(spark, sf, "events").withColumn("decision", F.expr("CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'denied' WHEN 2 THEN 'completed' END"))
    return temporal.request_states(e, "2024-01-31", 20 * _DAY, decision="decision").select("event_id", "user_id", "state")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 3600000000) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def session_touches(spark, sf):
    return temporal.touches(table(spark, sf, "events"), 3600).select("user_id", "event_id")


_JOBS = """jobs AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS processed, count(*) FILTER (WHERE event_type = 'error') AS failed,
    round(max(value), 4) AS largest FROM events GROUP BY user_id, day)"""


def _jobs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.max("value"), 4).alias("largest"))


@query(d.with_(_JOBS) + "SELECT user_id, day, processed, failed FROM jobs ORDER BY day DESC, user_id LIMIT 20")
def recent_jobs(spark, sf):
    return _jobs(spark, sf).orderBy(F.desc("day"), "user_id").limit(20).select("user_id", "day", "processed", "failed")


@query(d.with_(_JOBS) + "SELECT user_id, day, CASE WHEN processed > 5 THEN 'failed' ELSE 'done' END AS status FROM jobs")
def abandon_running(spark, sf):
    jobs = _jobs(spark, sf).select("user_id", "day", F.when(F.col("processed") > 5, "running").otherwise("done").alias("status"), F.lit(None).cast("timestamp").alias("finished_at"))
    return temporal.abandoned(jobs, F.to_timestamp(F.lit("2024-02-01"))).select("user_id", "day", "status")


@query(
    """SELECT user_id, event_id, query, place FROM (SELECT user_id, event_id, query, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM (
    SELECT user_id, event_id, ts, event_type || (event_id % 5) AS query FROM events QUALIFY row_number() OVER (PARTITION BY user_id, query ORDER BY ts DESC, event_id DESC) = 1)) WHERE place <= 8"""
)
def mru_searches(spark, sf):
    s = table(spark, sf, "events").select("user_id", "event_id", "ts", F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("query"))
    return temporal.recent_terms(s).select("user_id", "event_id", "query", F.col("place").cast("long").alias("place"))


@query(
    d.with_(d.PASSAGES)
    + """, g AS (SELECT document_id, a, b, max(b) OVER (PARTITION BY document_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT document_id, CAST(vec_id % 60 * 3 AS INTEGER) AS a, CAST(vec_id % 60 * 3 + token_count % 5 AS INTEGER) AS b FROM passages)),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT document_id, min(a) AS start, max(b) AS "end" FROM n GROUP BY document_id, island"""
)
def merged_ranges(spark, sf):
    p = d.passages(spark, sf)
    r = p.select("document_id", (F.col("vec_id") % 60 * 3).cast("int").alias("start"), (F.col("vec_id") % 60 * 3 + F.col("token_count") % 5).cast("int").alias("end"))
    return temporal.merged_ranges(r, "document_id")


_BLOCKS = """blocks AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) AS "order" FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|li)[^>]*>[^<]*') AS b FROM pages WHERE html IS NOT NULL))"""


def _blocks(spark, sf):
    p = table(spark, sf, "pages").where("html IS NOT NULL")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(?:h1|li)[^>]*>[^<]*"), F.lit(0))).alias("order", "block")).withColumn("order", F.col("order") + 1)


@query(d.with_(_BLOCKS) + """SELECT page_id, CAST("order" AS INTEGER) AS "order", CASE WHEN block LIKE '<h1%' THEN 'heading' ELSE 'paragraph' END AS kind, regexp_replace(block, '^<[^>]*>', '') AS text FROM blocks""")
def html_blocks(spark, sf):
    return _blocks(spark, sf).select("page_id", "order", F.when(F.col("block").startswith("<h1"), "heading").otherwise("paragraph").alias("kind"), F.regexp_replace("block", "^<[^>]*>", "").alias("text"))


def _lines(spark, sf):
    """A line of a page for each order line: what it says, how large, and whether it stands in a margin."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc", "l_linenumber AS page", "concat(l_linestatus, ' ', l_linenumber) AS text", "l_discount * 100 AS size", "CAST(l_quantity AS INT) AS n", "l_suppkey",
        "0.0D AS top", "CASE WHEN l_returnflag = 'N' THEN 500.0D ELSE 20.0D END AS bottom", "1000.0D AS page_height", "l_linestatus", "l_linenumber = 1 AS is_last", "l_returnflag = 'R' AS trailing_space",
    )


@query("SELECT l_orderkey AS doc, l_linestatus || '#' AS key FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey, key HAVING count(DISTINCT l_linenumber) >= 3")
def running_headers(spark, sf):
    return layout.running_keys(_lines(spark, sf))


@query("SELECT l_orderkey AS doc, arg_max(size, (n, -size)) AS body_size FROM (SELECT l_orderkey, round(l_discount * 100, 1) AS size, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, size) GROUP BY l_orderkey")
def body_font_mode(spark, sf):
    return layout.body_sizes(_lines(spark, sf).withColumn("text", F.repeat(F.lit("x"), F.col("n"))))


@query("SELECT l_suppkey AS doc, count(*) AS line_ends, count(*) FILTER (WHERE l_returnflag = 'R') AS with_space, count(*) >= 20 AND CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) >= 0.2 AS midword FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber <> 1 GROUP BY l_suppkey")
def midword_evidence(spark, sf):
    lines = _lines(spark, sf).withColumns({"doc": F.col("l_suppkey"), "text": F.expr("CASE WHEN l_linestatus = 'O' THEN '필터 교체 ' ELSE 'end' END")})
    return layout.midword_evidence(lines)


def _paged(spark, sf):
    """Documents as pages of blocks: a heading of two words, then the text, a page for each 2000 characters."""
    t = table(spark, sf, "documents").where("text IS NOT NULL")
    n = F.greatest(F.ceil(F.length("text") / 2000).cast("int"), F.lit(1))
    page = lambda i: F.struct((i + 1).alias("page_number"), F.array(F.struct(F.lit("heading").alias("kind"), F.substring_index("text", " ", 2).alias("text")), F.struct(F.lit("paragraph").alias("kind"), F.substring("text", i * 2000 + 1, F.lit(2000)).alias("text"))).alias("blocks"))
    return t.select(F.col("doc_id").cast("string").alias("document_id"), F.transform(F.sequence(F.lit(0), n - 1), page).alias("pages"))


@query()
def chunk_documents(spark, sf):
    return chunking.chunk(_paged(spark, sf))


_SIGNS = "length(regexp_replace({0}, '\\s+', '', 'g'))"


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST({_SIGNS.format("text")} + greatest(ceil(length(text) / 2000.0), 1) * {_SIGNS.format("array_to_string(string_split(text, ' ')[1:2], ' ')")} AS BIGINT) AS signs,
    0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS backwards FROM documents WHERE {_SIGNS.format("text")} > 0"""
)
def chunk_invariants(spark, sf):
    """Without overlap and repeated headings every sign of a document is in one passage; none beyond the budget, indices without gaps, pages in order."""
    p = chunking.chunk(_paged(spark, sf), chunking.Budget(overlap=0, repeat_heading=False))
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    seen = p.select("*", F.lag("page_start").over(order).alias("before"), F.row_number().over(order).alias("n"))
    return seen.groupBy("document_id").agg(
        F.sum("token_count").alias("signs"), F.count_if(F.col("token_count") > 450).alias("too_long"), F.count_if(F.col("chunk_index") != F.col("n") - 1).alias("gaps"), F.count_if(F.col("page_start") < F.col("before")).alias("backwards")
    )


@query("SELECT 'A' AS preset, count(*) AS documents FROM documents WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0 UNION ALL SELECT 'B', count(*) FROM documents WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0 UNION ALL SELECT 'C', count(*) FROM documents WHERE length(regexp_replace(text, '\\s+', '', 'g')) > 0")
def chunk_presets(spark, sf):
    """Each preset gives every document that has text at least one passage."""
    paged = _paged(spark, sf)
    parts = [chunking.chunk(paged, b).select("document_id").distinct().agg(F.count("*").alias("documents")).select(F.lit(k).alias("preset"), "documents") for k, b in chunking.PRESETS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _repeated(previous: pd.Series, current: pd.Series, heading: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([chunking.repeated_start(a, b, h) for a, b, h in zip(previous, current, heading)], columns=["start", "length"])


@query()
def passage_overlap(spark, sf):
    """Where each passage repeats the end of the one before: the lag is a window, the match an Arrow function."""
    p = chunking.chunk(_paged(spark, sf))
    before = p.withColumn("previous", F.lag("text").over(Window.partitionBy("document_id").orderBy("chunk_index")))

    found = before.withColumn("o", F.pandas_udf(_repeated, "start int, length int")("previous", "text", "heading"))
    return found.select("document_id", "chunk_index", F.col("o.start").alias("start"), F.col("o.length").alias("length"))
