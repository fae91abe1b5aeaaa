"""Intermediate tables in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, one machine gets a temporary folder and a cluster an error."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own = _own or tempfile.mkdtemp(prefix="lexmere-")
    spark.sparkContext.setCheckpointDir(_own)
    return _own


def place(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or a set of files."""
    return f"{folder(spark)}/lexmere/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again: its lineage ends there, and a lost executor costs no recomputation."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
