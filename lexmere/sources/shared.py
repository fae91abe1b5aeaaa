"""Tables and streams' checkpoints in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing stands under yet. Where the session names no folder, one machine gets a temporary one and a cluster an error."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own = _own or tempfile.mkdtemp(prefix="lexmere-")
    return f"{folder.rstrip('/')}/lexmere/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
