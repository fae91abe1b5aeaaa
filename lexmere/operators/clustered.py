"""Passage tables whose files are skipped: rows in ranges of owner, document and language, and what each file spans.

Files are written from ranges of the keys, sorted within, with Bloom filters on the ids. A
small table beside them keeps each file's least and greatest keys, so an equality
predicate names the files that can hold a match and the others are never opened;
within these the reader skips row groups by the same statistics and filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

KEYS = ("owner_id", "document_id", "language")
BLOOM = ("document_id", "filename")


def write(passages: DataFrame, files: int, path: str | None = None, keys: tuple[str, ...] = KEYS) -> str:
    """Writes the table in about so many files and returns its path."""
    path = path or shared.fresh(passages.sparkSession, "clustered")
    out = passages.repartitionByRange(files, *[F.col(k) for k in keys]).sortWithinPartitions(*keys).write
    for c in BLOOM:
        if c in passages.columns:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(f"{path}/data")
    spans = [f(k).alias(f"{name}_{k}") for k in keys for name, f in (("least", F.min), ("most", F.max))]
    held = passages.sparkSession.read.schema(passages.schema).parquet(f"{path}/data")
    nulls = [F.count_if(F.col(k).isNull()).alias(f"nulls_{k}") for k in keys]
    held.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *spans, *nulls).coalesce(1).write.parquet(f"{path}/spans")
    return path


def spans(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, least and greatest of each key): one row a file."""
    return spark.read.parquet(f"{path}/spans")


def _may_hold(filters: dict[str, str | None]) -> Column:
    out = F.lit(True)
    for k, v in filters.items():
        out = out & ((F.col(f"nulls_{k}") > 0) if v is None else (F.lit(v).between(F.col(f"least_{k}"), F.col(f"most_{k}"))))
    return out


def read(spark: SparkSession, path: str, filters: dict[str, str | None]) -> DataFrame:
    """The rows with keys equal to these; a None asks for nulls. Only files that can hold some are opened."""
    known = spans(spark, path)
    unknown = [k for k in filters if f"least_{k}" not in known.columns]
    if unknown:
        raise ValueError(f"not clustered by {', '.join(unknown)}")
    # one row a file of the table, of those that can hold a match
    files = [r[0] for r in known.where(_may_hold(filters)).select("file").collect()]
    schema = spark.read.parquet(f"{path}/data").schema
    if not files:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(*files)
    for k, v in filters.items():
        found = found.where(F.col(k).isNull() if v is None else F.col(k) == v)
    return found


def files_opened(found: DataFrame) -> int:
    """How many files the scans of a query that has run have listed."""
    plan = found._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.metrics().contains("numFiles"):
            total += leaf.metrics().apply("numFiles").value()
    return total
