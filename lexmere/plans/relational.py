"""Access, manifest, bookkeeping and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import access, manifest, search
from ..operators.access import Scope
from . import derived as d
from .catalog import QUERIES, ORACLE_SQL, query, table

M, P, U = d.with_(d.MANIFEST), d.with_(d.PASSAGES), d.USERS

_SCOPES = {
    "all": (Scope("u1", "all"), "owner_id = 'u1' OR visibility = 'public'"),
    "mine": (Scope("u1", "mine"), "owner_id = 'u1'"),
    "public": (Scope("u1", "public"), "visibility = 'public'"),
    "visitor": (access.scope_for(None, False), "owner_id = '-' OR visibility = 'public'"),
    "admin": (access.scope_for("u0", True), "true"),
}
for _mode, (_scope, _sql) in _SCOPES.items():
    QUERIES[f"acl_documents_{_mode}"] = lambda spark, sf, s=_scope: d.manifest(spark, sf).where(access.readable(s)).select("doc_id", "document_id", "filename", "owner_id", "visibility")
    ORACLE_SQL[f"acl_documents_{_mode}"] = M + f"SELECT doc_id, document_id, filename, owner_id, visibility FROM manifest WHERE {_sql}"


@query(M + "SELECT doc_id, document_id, filename FROM manifest WHERE language = 'fr' AND visibility = 'public' AND (owner_id = 'u2' OR visibility = 'public')")
def filter_conjunction(spark, sf):
    kept = d.manifest(spark, sf).where(access.matching({"language": "fr", "visibility": "public", "owner_id": None}) & access.readable(Scope("u2")))
    return kept.select("doc_id", "document_id", "filename")


@query(P + "SELECT vec_id, document_id, kind FROM passages WHERE kind IS DISTINCT FROM 'heading'")
def filter_headings(spark, sf):
    return d.passages(spark, sf).where(access.searchable()).select("vec_id", "document_id", "kind")


@query(M + "SELECT doc_id, status FROM manifest WHERE status = 'failed'")
def documents_by_status(spark, sf):
    return d.manifest(spark, sf).where("status = 'failed'").select("doc_id", "status")


@query(M + "SELECT doc_id, regexp_extract(filepath, '^/d/users/([^/]+)/.+', 1) AS owner FROM manifest")
def owner_from_path(spark, sf):
    return d.manifest(spark, sf).select("doc_id", ids.owner_for(F.col("filepath"), "/d").alias("owner"))


@query(d.with_(d.MANIFEST, U) + "SELECT doc_id, filepath FROM manifest WHERE owner_id IN (SELECT user_id FROM users WHERE NOT is_admin)")
def owned_files(spark, sf):
    known = d.users(spark, sf).where("NOT is_admin").select(F.col("user_id").alias("owner_id"))
    return d.manifest(spark, sf).join(known, "owner_id", "left_semi").select("doc_id", "filepath")


@query(M + "SELECT doc_id, filepath FROM manifest WHERE filepath = '/d/users/u1' OR filepath LIKE '/d/users/u1/%'")
def files_within(spark, sf):
    return d.manifest(spark, sf).where(ids.within(F.col("filepath"), F.lit("/d/users/u1"))).select("doc_id", "filepath")


@query(
    d.with_(d.MANIFEST, U)
    + """SELECT doc_id, owner_id = 'u1' AS is_mine, CASE WHEN owner_id = 'u1' THEN filepath ELSE '' END AS filepath, CAST(NULL AS VARCHAR) AS owner_id, CAST(NULL AS VARCHAR) AS owner_name
    FROM manifest WHERE owner_id = 'u1' OR visibility = 'public'"""
)
def masked_hits(spark, sf):
    hits = d.manifest(spark, sf).where(access.readable(Scope("u1")))
    return access.masked_hits(hits, "u1", False, d.users(spark, sf)).select("doc_id", "is_mine", "filepath", "owner_id", "owner_name")


@query(d.with_(d.MANIFEST, U) + "SELECT doc_id, owner_id = 'u0' AS is_mine, filepath, owner_id, username AS owner_name FROM manifest LEFT JOIN users ON owner_id = user_id")
def masked_hits_admin(spark, sf):
    return access.masked_hits(d.manifest(spark, sf), "u0", True, d.users(spark, sf)).select("doc_id", "is_mine", "filepath", "owner_id", "owner_name")


@query(
    M
    + """SELECT doc_id, owner_id = 'u2' AS is_mine, owner_id = 'u2' AS can_manage, CASE WHEN owner_id = 'u2' THEN filepath ELSE '' END AS filepath,
    CASE WHEN owner_id = 'u2' THEN file_hash ELSE '' END AS file_hash, CAST(NULL AS VARCHAR) AS owner_id FROM manifest WHERE owner_id = 'u2' OR visibility = 'public'"""
)
def masked_documents(spark, sf):
    shown = access.masked_documents(d.manifest(spark, sf).where(access.readable(Scope("u2"))), "u2", False)
    return shown.select("doc_id", "is_mine", "can_manage", "filepath", "file_hash", "owner_id")


@query(M + "SELECT owner_id, count(*) AS documents, count(*) FILTER (WHERE visibility = 'public') AS public_documents, CAST(sum(chunks) AS BIGINT) AS passages FROM manifest WHERE status = 'indexed' GROUP BY owner_id")
def owner_counts(spark, sf):
    return manifest.owner_counts(d.manifest(spark, sf))


@query(M + "SELECT count(*) AS documents, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS passages FROM manifest WHERE owner_id = 'u3' OR visibility = 'public'")
def totals_scoped(spark, sf):
    return manifest.totals(d.manifest(spark, sf).where(access.readable(Scope("u3"))))


@query(M + "SELECT status, count(*) AS documents FROM manifest GROUP BY status")
def status_breakdown(spark, sf):
    return d.manifest(spark, sf).groupBy("status").agg(F.count("*").alias("documents"))


@query(
    P
    + """SELECT document_id, count(*) AS chunks, max(page_end) AS pages, arg_min(filename, chunk_index) AS filename, arg_min(filepath, chunk_index) AS filepath,
    arg_min(language, chunk_index) AS language, arg_min(owner_id, chunk_index) AS owner_id, arg_min(visibility, chunk_index) AS visibility FROM passages GROUP BY document_id"""
)
def rebuild_manifest(spark, sf):
    return manifest.rebuild(d.passages(spark, sf))


@query(
    d.with_(d.MANIFEST, U)
    + """SELECT user_id, username, coalesce(n, 0) AS documents, coalesce(p, 0) AS passages FROM users LEFT JOIN
    (SELECT owner_id, count(*) AS n, CAST(sum(chunks) AS BIGINT) AS p FROM manifest WHERE status = 'indexed' AND language = 'es' AND owner_id <> 'u2' GROUP BY owner_id) ON owner_id = user_id"""
)
def users_with_counts(spark, sf):
    counts = manifest.owner_counts(d.manifest(spark, sf).where("language = 'es' AND owner_id <> 'u2'")).withColumnRenamed("owner_id", "user_id")
    return d.users(spark, sf).join(counts, "user_id", "left").select("user_id", "username", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("passages", F.lit(0)).alias("passages"))


@query(P + "SELECT count(*) AS passages FROM passages WHERE owner_id = 'src1' OR visibility = 'public'")
def count_passages_scoped(spark, sf):
    return d.passages(spark, sf).where(access.readable(Scope("src1"))).agg(F.count("*").alias("passages"))


@query(P + "SELECT count(*) AS points, count(DISTINCT document_id) AS documents, max(len(embedding)) AS dimension FROM passages")
def describe_passages(spark, sf):
    return search.describe(d.passages(spark, sf)).withColumn("dimension", F.col("dimension").cast("long"))


@query(P + "SELECT vec_id, document_id, chunk_index, (SELECT count(*) FROM passages WHERE document_id = '3') AS total FROM passages WHERE document_id = '3' AND chunk_index >= 5 AND chunk_index < 15")
def passages_of_document(spark, sf):
    return search.list_passages(d.passages(spark, sf), "3", 5, 10).select("vec_id", "document_id", "chunk_index", "total")


@query(P + "SELECT vec_id, token_count FROM passages WHERE document_id = '2' AND chunk_index = 4")
def passage_by_id(spark, sf):
    return d.passages(spark, sf).where("document_id = '2' AND chunk_index = 4").select("vec_id", "token_count")


_PATHS = M + ", grouped AS (SELECT document_id, min(filepath) AS filepath, list_sort(list(DISTINCT filepath)) AS paths FROM manifest GROUP BY document_id)\n"


@query(_PATHS + "SELECT document_id, filepath, array_to_string(paths[2:], ',') AS alternates, len(paths) AS copies FROM grouped")
def exact_duplicates(spark, sf):
    found = manifest.exact_duplicates(d.manifest(spark, sf))
    return found.select("document_id", "filepath", F.array_join("alt_filepaths", ",").alias("alternates"), (F.size("alt_filepaths") + 1).cast("long").alias("copies"))


@query(_PATHS + "SELECT path, document_id FROM (SELECT unnest(paths) AS path, document_id FROM grouped)")
def known_paths_lookup(spark, sf):
    return manifest.by_path(manifest.exact_duplicates(d.manifest(spark, sf)).withColumn("filename", F.col("filepath"))).select("path", "document_id")


@query(_PATHS + "SELECT document_id, array_to_string(paths[2:], ',') AS alternates, paths[2] AS filepath FROM (SELECT document_id, paths FROM grouped WHERE len(paths) > 1)")
def forget_primary_path(spark, sf):
    one = manifest.exact_duplicates(d.manifest(spark, sf)).where(F.size("alt_filepaths") > 0)
    left = one.withColumn("_l", F.array_remove(F.array_union(F.array("filepath"), F.col("alt_filepaths")), F.col("filepath")))
    return left.select("document_id", F.array_join("_l", ",").alias("alternates"), F.element_at("_l", 1).alias("filepath"))


_OLD = M + ", old AS (SELECT * FROM manifest WHERE doc_id % 3 <> 1)\n"


def _old(spark, sf):
    return d.manifest(spark, sf).where("doc_id % 3 <> 1")


@query(_OLD + "SELECT doc_id FROM manifest WHERE document_id NOT IN (SELECT document_id FROM old WHERE status IN ('indexed', 'unsupported'))")
def incremental_pending(spark, sf):
    return manifest.pending(d.manifest(spark, sf), _old(spark, sf)).select("doc_id")


@query(_OLD + "SELECT m.doc_id, m.filepath FROM manifest m WHERE m.filepath LIKE '/d/users/u1/%' AND m.document_id NOT IN (SELECT document_id FROM old)")
def sweep_deleted(spark, sf):
    return manifest.vanished(d.manifest(spark, sf), _old(spark, sf), ["/d/users/u1", "/d/users/u2"], ["/d/users/u2"]).select("doc_id", "filepath")


@query(
    M
    + """SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'dropped' WHEN a.path IS NULL THEN 'added' ELSE 'kept' END AS change
    FROM (SELECT filepath AS path FROM manifest WHERE doc_id % 2 = 0) a FULL JOIN (SELECT filepath AS path FROM manifest WHERE doc_id % 3 = 0) b ON a.path = b.path"""
)
def sync_diff(spark, sf):
    m = d.manifest(spark, sf).withColumnRenamed("filepath", "path")
    return manifest.sync(m.where("doc_id % 2 = 0"), m.where("doc_id % 3 = 0"))


_VERSIONS = M + ", versions AS (SELECT document_id, '/d/v/' || (doc_id % 50) AS filepath, doc_id, doc_id % 21 = 0 AS public FROM manifest)\n"


def _versions(spark, sf):
    return d.manifest(spark, sf).select("document_id", F.concat(F.lit("/d/v/"), (F.col("doc_id") % 50).cast("string")).alias("filepath"), "doc_id", (F.col("doc_id") % 21 == 0).alias("public"))


@query(_VERSIONS + "SELECT doc_id FROM versions v WHERE EXISTS (SELECT 1 FROM versions o WHERE o.filepath = v.filepath AND o.document_id <> v.document_id AND o.document_id IN (SELECT document_id FROM versions WHERE public))")
def carry_public(spark, sf):
    v = _versions(spark, sf)
    return manifest.carried_public(v, v.where("public")).select("doc_id")


@query(_VERSIONS + "SELECT doc_id, filepath, lag(doc_id) OVER (PARTITION BY filepath ORDER BY doc_id) AS previous FROM versions")
def previous_version(spark, sf):
    return _versions(spark, sf).select("doc_id", "filepath", F.lag("doc_id").over(Window.partitionBy("filepath").orderBy("doc_id")).alias("previous"))


@query(M + "SELECT doc_id, language, CASE WHEN doc_id % 10 = 0 THEN 'public' ELSE visibility END AS visibility FROM manifest")
def update_visibility(spark, sf):
    m = d.manifest(spark, sf)
    return manifest.set_where(m, F.col("doc_id") % 10 == 0, {"visibility": F.lit("public")}).select("doc_id", "language", "visibility")


@query(M + "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE chunks END AS chunks, owner_id FROM manifest")
def manifest_upsert(spark, sf):
    m = d.manifest(spark, sf).select("doc_id", "chunks", "owner_id")
    return manifest.upsert(m, m.where("doc_id % 6 = 0").withColumn("chunks", F.lit(0)), ["doc_id"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(spark, sf):
    return manifest.latest(table(spark, sf, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query(P + "SELECT vec_id, CASE WHEN document_id = '4' THEN 'new' ELSE document_id END AS document_id, CASE WHEN document_id = '4' THEN 'u9' ELSE owner_id END AS owner_id FROM passages")
def rekey_document(spark, sf):
    return manifest.rekey(d.passages(spark, sf), "4", "new", "u9", "/d/new.pdf", "new.pdf").select("vec_id", "document_id", "owner_id")


@query(P + "SELECT vec_id, document_id, token_count FROM passages WHERE document_id <> '1' UNION ALL SELECT vec_id, document_id, 1 FROM passages WHERE document_id = '1' AND vec_id % 2 = 0")
def replace_document(spark, sf):
    p = d.passages(spark, sf).select("vec_id", "document_id", "token_count")
    return manifest.replace_documents(p, p.where("document_id = '1' AND vec_id % 2 = 0").withColumn("token_count", F.lit(1)))


@query(P + "SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 'library' ELSE owner_id END AS owner_id FROM passages")
def backfill_owner(spark, sf):
    p = d.passages(spark, sf).withColumn("owner_id", F.when(F.col("vec_id") % 6 != 0, F.col("owner_id")))
    return manifest.with_owner_defaults(p).select("vec_id", "owner_id")


@query(M + ", asked AS (SELECT document_id, doc_id AS position FROM manifest WHERE doc_id % 7 = 0) SELECT document_id, min(position) AS position, CASE WHEN bool_or(owner_id = 'u1') THEN 'updated' ELSE 'unknown' END AS outcome FROM asked JOIN (SELECT document_id, owner_id FROM manifest) USING (document_id) GROUP BY document_id")
def split_request(spark, sf):
    m = d.manifest(spark, sf)
    return access.split_request(m.where("doc_id % 7 = 0").select("document_id", F.col("doc_id").alias("position")), m.where("owner_id = 'u1'"))


@query(
    M
    + """, w AS (SELECT doc_id AS position, (doc_id % 5) || '.txt' AS name FROM manifest)
    SELECT position, name, CASE WHEN turn = 1 THEN name ELSE regexp_replace(name, '\\.txt$', '') || ' (' || turn || ').txt' END AS given
    FROM (SELECT position, name, row_number() OVER (PARTITION BY name ORDER BY position) + CASE WHEN name IN ('1.txt', '3.txt') THEN 1 ELSE 0 END AS turn FROM w)"""
)
def unique_names(spark, sf):
    wanted = d.manifest(spark, sf).select(F.col("doc_id").alias("position"), F.concat((F.col("doc_id") % 5).cast("string"), F.lit(".txt")).alias("name"))
    return manifest.unique_names(wanted, spark.createDataFrame([("1.txt",), ("3.txt",)], "name string"))


@query(
    """WITH r AS (SELECT event_id AS position, event_type AS scope, 'd' || (user_id % 3) AS directory, user_id % 2 = 0 AS force, CASE WHEN event_id % 40 <> 0 THEN 'p' || (event_id % 6) END AS path FROM events)
    SELECT r.scope, r.directory, r.force, min(position) AS position, CASE WHEN count(*) = count(path) THEN any_value(paths) END AS paths FROM r LEFT JOIN (SELECT scope, directory, force, string_agg(path, ',' ORDER BY first) AS paths FROM (SELECT scope, directory, force, path, min(position) AS first FROM r WHERE path IS NOT NULL GROUP BY scope, directory, force, path) GROUP BY scope, directory, force) o ON o.scope = r.scope AND o.directory = r.directory AND o.force = r.force GROUP BY r.scope, r.directory, r.force"""
)
def merge_run_requests(spark, sf):
    path = F.concat(F.lit("p"), (F.col("event_id") % 6).cast("string"))
    r = table(spark, sf, "events").select(F.col("event_id").alias("position"), F.col("event_type").alias("scope"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("directory"), (F.col("user_id") % 2 == 0).alias("force"), F.when(F.col("event_id") % 40 != 0, F.array(path)).alias("paths"))
    return manifest.merge_requests(r).withColumn("paths", F.when(F.col("paths").isNotNull(), F.array_join("paths", ",")))


@query(
    M
    + """SELECT filepath AS path, CASE WHEN doc_id % 19 = 0 THEN 'processing' WHEN doc_id % 11 = 0 THEN 'queued' WHEN doc_id % 3 <> 1 THEN status ELSE 'not_indexed' END AS state FROM manifest"""
)
def file_states(spark, sf):
    m = d.manifest(spark, sf).withColumnRenamed("filepath", "path")
    return manifest.file_states(m.select("path"), m.where("doc_id % 3 <> 1"), m.where("doc_id % 19 = 0"), m.where("doc_id % 11 = 0"))


@query(d.with_(U) + "SELECT user_id, username FROM users WHERE is_admin ORDER BY created_on LIMIT 1")
def first_admin(spark, sf):
    return d.users(spark, sf).where("is_admin").agg(F.min_by("user_id", "created_on").alias("user_id"), F.min_by("username", "created_on").alias("username"))


@query(M + "SELECT count(*) FILTER (WHERE status = 'indexed') AS indexed, CAST(sum(chunks) FILTER (WHERE status = 'indexed') AS BIGINT) AS passages, count(*) FILTER (WHERE status IN ('failed', 'unsupported')) AS troubled FROM manifest")
def library_summary(spark, sf):
    ok = F.col("status") == "indexed"
    return d.manifest(spark, sf).agg(F.count_if(ok).alias("indexed"), F.sum(F.when(ok, F.col("chunks"))).alias("passages"), F.count_if(F.col("status").isin("failed", "unsupported")).alias("troubled"))


@query(M + "SELECT doc_id, filename FROM manifest WHERE lower(filename) LIKE '%12%' AND status <> 'indexed'")
def name_filter(spark, sf):
    return d.manifest(spark, sf).where(F.lower("filename").contains("12") & (F.col("status") != "indexed")).select("doc_id", "filename")


@query(M + "SELECT doc_id, filename, row_number() OVER (ORDER BY filename, doc_id) AS place FROM manifest")
def documents_sorted(spark, sf):
    return manifest.numbered(d.manifest(spark, sf).select("doc_id", "filename"), "filename", "doc_id")


@query(M + "SELECT owner_id, count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS passages FROM manifest WHERE owner_id = 'u2' GROUP BY owner_id")
def deleted_user_totals(spark, sf):
    return d.manifest(spark, sf).where("owner_id = 'u2'").groupBy("owner_id").agg(F.count("*").alias("documents"), F.sum("chunks").alias("passages"))


@query(M + "SELECT doc_id, sha1('x') AS probe, substr(lower(sha1(concat(document_id, ':0'))), 1, 8) AS key FROM manifest")
def name_hashes(spark, sf):
    return d.manifest(spark, sf).select("doc_id", F.sha1(F.lit("x").cast("binary")).alias("probe"), F.substring(F.sha1(F.concat_ws(":", "document_id", F.lit("0")).cast("binary")), 1, 8).alias("key"))


@query(
    M
    + """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
    FROM (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(document_id || ':' || (doc_id % 7))) AS h FROM manifest)"""
)
def point_ids(spark, sf):
    return d.manifest(spark, sf).select("doc_id", ids.point_id(F.col("document_id"), F.col("doc_id") % 7).alias("point_id"))


@query(M + "SELECT doc_id, filename, CASE WHEN filename LIKE '%.docx' THEN 'docx' ELSE 'pdf' END AS kind FROM manifest")
def file_types(spark, sf):
    return d.manifest(spark, sf).select("doc_id", "filename", text.file_type(F.col("filename")).alias("kind"))


@query("SELECT c_custkey, regexp_matches(lower(trim(c_name)), '^[a-z0-9][a-z0-9._-]{2,31}$') AS valid FROM customer")
def valid_usernames(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", access.valid_username(F.col("c_name")).alias("valid"))
