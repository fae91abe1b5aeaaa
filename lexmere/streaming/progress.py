"""Progress of a run, observed while it goes on: no second pass over its rows.

A run's rows (path, state, chunks, place) are counted by df.observe() where they pass; a
batch job answers when it ends, a stream after each batch, through a listener that adds
the batches up. What is observed is of fixed size: counts for each state, passages, and the
file that passed last. A snapshot is what a reader of the run's status gets.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import shared

STATES = ("queued", "processing", "indexed", "skipped", "unsupported", "failed", "deleted")
#: states of files that a run is done with
DONE = ("indexed", "skipped", "unsupported", "failed")
SNAPSHOT = "run string, stage string, total long, processed long, " + ", ".join(f"{s} long" for s in STATES) + ", chunks long, progress double, current_file string"


def measures() -> list[Column]:
    """What is observed of rows (path, state, chunks, place)."""
    state = F.col("state")
    counts = [F.count_if(state == s).alias(s) for s in STATES]
    return [F.count("*").alias("rows"), *counts, F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.max_by("path", "place").alias("current_file")]


@dataclass
class Counts:
    """The counts of a stage so far."""

    total: int | None = None
    seen: dict[str, int] = field(default_factory=dict)
    current_file: str | None = None

    def add(self, row: Row) -> None:
        for name, value in row.asDict().items():
            if name == "current_file":
                self.current_file = value if value is not None else self.current_file
            else:
                self.seen[name] = self.seen.get(name, 0) + (value or 0)

    def snapshot(self, run: str, stage: str) -> tuple:
        processed = sum(self.seen.get(s, 0) for s in DONE)
        total = self.seen.get("rows", 0) if self.total is None else self.total
        return (run, stage, total, processed, *(self.seen.get(s, 0) for s in STATES), self.seen.get("chunks", 0), round(min(1.0, processed / total), 3) if total else 0.0, self.current_file)


class Run:
    """A run of stages; each writes its rows once and is observed meanwhile."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.stages: dict[str, Counts] = {}

    def stage(self, stage: str, rows: DataFrame, total: int | None = None) -> DataFrame:
        """The rows (path, state, chunks, place and others) as a table; their counts are the stage's."""
        seen = Observation(f"{self.name}/{stage}")
        out = shared.written(rows.observe(seen, *measures()), "stage")
        counts = self.stages[stage] = Counts(total)
        found = seen.get
        counts.add(Row(**found) if found else Row(rows=0))
        return out

    def snapshot(self) -> DataFrame:
        """SNAPSHOT, a row for each stage."""
        return self.spark.createDataFrame([c.snapshot(self.name, s) for s, c in self.stages.items()], SNAPSHOT)


class Listener(StreamingQueryListener):
    """Adds up what a stream's batches have observed under a name; a batch that is run again counts once."""

    def __init__(self, name: str, total: int | None = None):
        self.name, self.counts = name, Counts(total)
        self._batches: set[int] = set()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        with self._lock:
            if row is not None and event.progress.batchId not in self._batches:
                self._batches.add(event.progress.batchId)
                self.counts.add(row)

    def snapshot(self, run: str) -> tuple:
        with self._lock:
            return self.counts.snapshot(run, "stream")


def observed_stream(rows: DataFrame, run: str, total: int | None = None) -> DataFrame:
    """SNAPSHOT of a stream of rows (path, state, chunks, place), after all that is there now has passed."""
    spark = rows.sparkSession
    listener = Listener(run, total)
    spark.streams.addListener(listener)
    try:
        done = rows.observe(run, *measures()).writeStream.format("noop").option("checkpointLocation", shared.fresh(spark, "progress")).trigger(availableNow=True).start()
        done.awaitTermination()
        # events come by a queue of their own
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([listener.snapshot(run)], SNAPSHOT)
