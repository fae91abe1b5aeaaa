"""Stateful streams, observed runs and change streams over the given tables, drained to what they give in the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from ..sources import shared
from ..streaming import indexing, progress, stateful
from . import derived as d
from .catalog import ORACLE_SQL, query, table

_DAY = 86_400


def _stream(spark, sf, name, **limits):
    # a pattern, so that a file and a folder of files read alike
    return spark.readStream.schema(table(spark, sf, name).schema).options(**limits).parquet(f"{sf}/{name}.parquet*")


def _timed(spark, sf):
    # a table's files are not cut by time: what a second batch brings would be late or out of order, so one batch takes them all
    return _stream(spark, sf, "events")


def _updates(spark, sf):
    # a timer's row repeats its session as it stands and touches nothing, so it can stay; an event may have no id
    return stateful.drained(stateful.session_updates(_timed(spark, sf), _DAY, 10 * _DAY, 3600), "sessions")


@query(ORACLE_SQL["session_idle"].replace("user_id, session, events FROM s", "user_id, session, events, started, last_seen FROM s"))
def session_stream(spark, sf):
    last = _updates(spark, sf).groupBy("user_id", "session").agg(F.max("events").alias("events"), F.timestamp_micros(F.min("started")).alias("started"), F.timestamp_micros(F.max("last_seen")).alias("last_seen"))
    return last.select("user_id", "session", "events", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "last_seen")])


@query(ORACLE_SQL["session_live"])
def session_stream_live(spark, sf):
    last = _updates(spark, sf).groupBy("user_id", "session").agg(F.max("events").alias("events"), F.timestamp_micros(F.min("started")).alias("started"), F.timestamp_micros(F.max("last_seen")).alias("last_seen"))
    return temporal.live_sessions(last, "2024-01-20", _DAY, 10 * _DAY).select("user_id", "session", "events")


@query(ORACLE_SQL["session_touches"])
def session_stream_touches(spark, sf):
    return _updates(spark, sf).where("touched").select("user_id", "event_id")


# the batch rule with the time until the oldest hit leaves, in whole seconds from 1
@query(
    """SELECT event_id, user_id, n AS in_window, n <= 5 AS allowed, CASE WHEN n > 5 THEN greatest(CAST(ceil((epoch_us(oldest) + 86400000000 - epoch_us(ts)) / 1000000) AS BIGINT), 1) END AS retry_after
    FROM (SELECT event_id, user_id, ts, count(*) OVER w AS n, min(ts) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW))"""
)
def throttle_stream(spark, sf):
    return stateful.drained(stateful.throttle(_timed(spark, sf), 5, _DAY), "throttle").select("event_id", "user_id", "in_window", "allowed", "retry_after")


_STATE = "CASE WHEN n_chars < 20 THEN 'unsupported' WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 5 = 1 THEN 'skipped' ELSE 'indexed' END"
_SEEN = f"s AS (SELECT doc_id, 'd' || doc_id AS path, {_STATE} AS state, CASE WHEN {_STATE} = 'indexed' THEN n_chars // 300 + 1 ELSE 0 END AS chunks FROM documents WHERE doc_id IS NOT NULL)"


def _files(df):
    state = F.expr(_STATE)
    return df.where("doc_id IS NOT NULL").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), state.alias("state"), F.when(state == "indexed", F.floor(F.col("n_chars") / 300) + 1).otherwise(0).alias("chunks"), F.col("doc_id").alias("place"))


_COUNTED = """count(*) AS total, count(*) FILTER (WHERE state IN ('indexed', 'skipped', 'unsupported', 'failed')) AS processed, 0 AS queued, 0 AS processing, count(*) FILTER (WHERE state = 'indexed') AS indexed,
    count(*) FILTER (WHERE state = 'skipped') AS skipped, count(*) FILTER (WHERE state = 'unsupported') AS unsupported, count(*) FILTER (WHERE state = 'failed') AS failed, 0 AS deleted, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks"""


@query(
    d.with_(_SEEN)
    + f"""SELECT 'nightly' AS run, 'looked up' AS stage, {_COUNTED}, 1.0 AS progress, arg_max(path, doc_id) AS current_file FROM s
    UNION ALL SELECT 'nightly', 'read', {_COUNTED}, 1.0, arg_max(path, doc_id) FROM s WHERE state <> 'skipped'
    UNION ALL SELECT 'nightly', 'stored', (SELECT count(*) FROM s), count(*), 0, 0, count(*), 0, 0, 0, 0, CAST(sum(chunks) AS BIGINT), round(count(*) / (SELECT count(*) FROM s), 3), arg_max(path, doc_id) FROM s WHERE state = 'indexed'"""
)
def run_progress(spark, sf):
    """Three stages of a run, each observed while its rows are written."""
    run = progress.Run(spark, "nightly")
    looked_up = run.stage("looked up", _files(table(spark, sf, "documents")))
    read = run.stage("read", looked_up.where("state <> 'skipped'"))
    run.stage("stored", read.where("state = 'indexed'"), total=run.stages["looked up"].seen["rows"])
    return run.snapshot()


@query(d.with_(_SEEN) + f"SELECT 'uploads' AS run, 'stream' AS stage, {_COUNTED}, CAST(1.0 AS DOUBLE) AS progress FROM s")
def run_progress_stream(spark, sf):
    return progress.observed_stream(_files(_stream(spark, sf, "documents", maxFilesPerTrigger=64)), "uploads").drop("current_file")


@query("SELECT DISTINCT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS step FROM events")
def change_stream(spark, sf):
    """Statuses are polled again and again; a change is a key that was not there before."""
    polled = _stream(spark, sf, "events", maxFilesPerTrigger=64).select("user_id", "event_type", F.floor(F.col("value") / 10).alias("step"), "ts")
    found = stateful.changes(polled, ["user_id", "event_type", "step"], late="36500 days")
    return stateful.drained(found, "changes").select("user_id", "event_type", "step")


@query(
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) + event_id % 7 * 3600000000, event_id ROWS UNBOUNDED PRECEDING) AS newest FROM events) WHERE event_id = newest"""
)
def answers_in_time(spark, sf):
    """Requests are answered up to six hours late; an answer that a later request's overtook is dropped."""
    e = table(spark, sf, "events").withColumn("arrived", F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 7 * 3_600_000_000)
    return temporal.not_overtaken(e, "user_id", "event_id", "arrived").select("user_id", "event_id")


_KINDS = {"documents": ("document_id string, doc_id long, owner_id string, chunks int", "document_id"), "passages": ("passage_id string, document_id string, owner_id string", "passage_id")}


@query(
    d.with_(d.MANIFEST)
    + """SELECT 'documents' AS "table", version, owner_id, count(*) AS rows FROM manifest, (VALUES (1), (2)) v(version) WHERE version = 1 OR owner_id <> 'u1' GROUP BY version, owner_id
    UNION ALL SELECT 'passages', version, owner_id, CAST(sum(chunks) AS BIGINT) FROM manifest, (VALUES (1), (2)) v(version) WHERE version = 1 OR owner_id <> 'u1' GROUP BY version, owner_id"""
)
def stored_deletion(spark, sf):
    """A stored library of two tables before and after an owner's rows leave both in one version."""
    m = d.manifest(spark, sf).select("document_id", "doc_id", "owner_id", "chunks")
    passages = m.select("document_id", "doc_id", "owner_id", F.explode(F.sequence(F.lit(1), F.col("chunks"))).alias("n")).select(F.concat_ws(":", "document_id", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("passage_id"), "document_id", "owner_id")
    library = indexing.Library(spark, shared.fresh(spark, "library"), _KINDS, buckets=8)
    library.change(lambda _: {"documents": m, "passages": passages})
    library.change(lambda held: {name: rows.where("owner_id <> 'u1'") for name, rows in held.items()})
    parts = [library.read(name, v).groupBy("owner_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(v).alias("version"), "owner_id", "rows") for name in _KINDS for v in (1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
