"""Sessions, throttles, expiring requests and histories as queries over event time. `as_of` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _seconds(c: str) -> Column:
    return _micros(c) / 1_000_000


def throttle(hits: DataFrame, limit: int, window_seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Each hit with the number in its window so far, whether it passes, and when the oldest leaves."""
    span = window_seconds * 1_000_000 - 1
    timed = hits.withColumn("_t", _micros(ts))
    recent = Window.partitionBy(key).orderBy("_t").rangeBetween(-span, 0)
    counted = timed.withColumns({"in_window": F.count("*").over(recent), "_first": F.min("_t").over(recent)})
    wait = F.ceil((F.col("_first") + window_seconds * 1_000_000 - F.col("_t")) / 1_000_000)
    return counted.withColumns({"allowed": F.col("in_window") <= limit, "retry_after": F.when(F.col("in_window") > limit, F.greatest(wait, F.lit(1)))}).drop("_t", "_first")


def sessions(events: DataFrame, idle_seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions end after a pause of idle_seconds: first and last event and their number."""
    order = Window.partitionBy(key).orderBy(ts)
    gap = _seconds(ts) - F.lag(_seconds(ts)).over(order)
    numbered = events.withColumn("_new", F.when(gap.isNull() | (gap >= idle_seconds), 1).otherwise(0)).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("last_seen"), F.count("*").alias("events"))


def live_sessions(found: DataFrame, as_of: str, idle_seconds: int, most_seconds: int) -> DataFrame:
    """Sessions that are neither idle nor past their greatest age at a moment."""
    now = F.unix_micros(F.to_timestamp(F.lit(as_of))) / 1_000_000
    return found.where((_seconds("started") <= now) & (now - _seconds("last_seen") < idle_seconds) & (now - _seconds("started") < most_seconds))


def request_states(requests: DataFrame, as_of: str, ttl_seconds: int, key: str = "user_id", ts: str = "ts", decision: str | None = None) -> DataFrame:
    """One open request a user: older ones are superseded, the last is pending until its time is over.

    decision names a column of what was done with a request: approved, denied or completed
    stand as they are, but an approval that was not used in time is expired.
    """
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("event_id"))
    now = F.unix_micros(F.to_timestamp(F.lit(as_of))) / 1_000_000
    ranked = requests.withColumn("_n", F.row_number().over(order))
    decided = F.lit(None).cast("string") if decision is None else F.col(decision)
    late = now - _seconds(ts) >= ttl_seconds
    state = F.when(decided.isin("denied", "completed"), decided).when((decided == "approved") & (F.col("_n") == 1) & ~late, "approved").when(F.col("_n") > 1, "superseded").when(now - _seconds(ts) >= ttl_seconds, "expired").otherwise("pending")
    return ranked.withColumn("state", state).drop("_n")


def recent_terms(searches: DataFrame, keep: int = 8, owner: str = "user_id", text: str = "query", ts: str = "ts") -> DataFrame:
    """Each owner's last searches, newest first, one for each text without regard to case."""
    by_text = Window.partitionBy(owner, F.lower(text)).orderBy(F.desc(ts), F.desc("event_id"))
    newest = searches.withColumn("_n", F.row_number().over(by_text)).where("_n = 1").drop("_n")
    by_time = Window.partitionBy(owner).orderBy(F.desc(ts), F.desc("event_id"))
    return newest.withColumn("place", F.row_number().over(by_time)).where(F.col("place") <= keep)


def abandoned(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that were running when the process ended become failed."""
    was = F.col("status") == "running"
    return jobs.withColumns({"finished_at": F.when(was, as_of).otherwise(F.col("finished_at")), "status": F.when(was, "failed").otherwise(F.col("status"))})


def merged_ranges(ranges: DataFrame, key: str, start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Ranges of a key that overlap or lie within gap of each other, as one."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(key, start, end).distinct().withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def touches(requests: DataFrame, every_seconds: int = 60, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """A session's requests at which its last-seen time is written: at most one in each stretch of every_seconds."""
    stretch = F.floor(_seconds(ts) / every_seconds)
    order = Window.partitionBy(key, stretch).orderBy(ts, "event_id")
    return requests.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def not_overtaken(answers: DataFrame, key: str, ticket: str, arrived: str) -> DataFrame:
    """Answers that arrived before any answer to a later request of their key."""
    so_far = Window.partitionBy(key).orderBy(arrived, ticket).rowsBetween(Window.unboundedPreceding, 0)
    return answers.withColumn("_newest", F.max(ticket).over(so_far)).where(F.col(ticket) == F.col("_newest")).drop("_newest")
