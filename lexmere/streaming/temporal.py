"""Sessions and throttles over an event stream. Late rows beyond the watermark are dropped; state ends with it."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

THROTTLED = "user_id long, event_id long, in_window int, allowed boolean"


def sessions(events: DataFrame, idle: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Sessions that end after an idle time: (user_id, started, last_seen, events)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.max("ts").alias("last_seen"), F.count("*").alias("events"))
    return found.select("user_id", F.col("w.start").alias("started"), "last_seen", "events")


def throttled(events: DataFrame, limit: int, window_seconds: int, late: str = "1 hour") -> DataFrame:
    """THROTTLED for each event: its place in the window so far, by event time; a key's times are its state."""

    def count(key: tuple, rows, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            now = r.ts.timestamp()
            times = [t for t in times if t > now - window_seconds] + [now]
            out.append((key[0], r.event_id, len(times), len(times) <= limit))
        state.update((times,))
        state.setTimeoutTimestamp(int((times[-1] + window_seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "in_window", "allowed"])

    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(count, THROTTLED, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
