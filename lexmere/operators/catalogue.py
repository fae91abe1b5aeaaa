"""What tables there are: columns, layout and counts from the session's catalogue, and a null row for one that is absent."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "name string, present boolean, format string, partitioned_by array<string>, bucketed_by array<string>, n_columns long"
COLUMNS = "name string, position int, column string, type string, nullable boolean"


def _described(spark: SparkSession, name: str) -> dict | None:
    if not spark.catalog.tableExists(name):
        return None
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0])


def layouts(spark: SparkSession, names: list[str]) -> DataFrame:
    """TABLES, a row for each name; nulls for a table that is not there."""
    rows = []
    for name in names:
        found = _described(spark, name)
        if found is None:
            rows.append((name, False, None, None, None, None))
        else:
            rows.append((name, True, (found.get("provider") or found.get("type") or "").lower(), found.get("partition_columns") or [], found.get("bucket_columns") or [], len(found["columns"])))
    return spark.createDataFrame(rows, TABLES)


def columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """COLUMNS of the tables that are there."""
    rows = []
    for name in names:
        for k, c in enumerate((_described(spark, name) or {"columns": []})["columns"], 1):
            rows.append((name, k, c["name"], c["type"]["name"], c.get("nullable", True)))
    return spark.createDataFrame(rows, COLUMNS)


def counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, rows): each table counted once, in one job over all of them."""
    there = [n for n in names if spark.catalog.tableExists(n)]
    if not there:
        return spark.createDataFrame([], "name string, rows long")
    parts = [spark.table(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in there]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe(spark: SparkSession, names: list[str]) -> DataFrame:
    """Layout and count of each name."""
    return layouts(spark, names).join(counts(spark, names), "name", "left")


def collection_status(spark: SparkSession, name: str, vector: str = "embedding") -> DataFrame:
    """One row: present, points, dimension and whether all vectors have it; nulls for an absent table."""
    kind = "name string, present boolean, points long, dimension int, even boolean"
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([(name, False, None, None, None)], kind)
    size = F.size(vector)
    return spark.table(name).agg(F.count("*").alias("points"), F.max(size).alias("dimension"), (F.coalesce(F.min(size), F.lit(0)) == F.coalesce(F.max(size), F.lit(0))).alias("even")).select(F.lit(name).alias("name"), F.lit(True).alias("present"), "points", "dimension", "even")
