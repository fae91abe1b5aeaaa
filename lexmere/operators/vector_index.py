"""An inverted file for exact vector search: passages in lists by nearest centroid, lists skipped by a bound.

A list knows its centroid and its radius, the greatest distance of a member from it. A
query's inner product with a member is at most q.c + |q| r, so a list whose bound is
below the k-th best score so far holds nothing. First each query reads its most promising
lists; the k-th best score there prunes the rest. The access predicate and the filters
stand below the scan of both passes, so the score that prunes is one the reader may see.

The table is partitioned by list: lists that no query needs are not opened. What is
broadcast are the centroids (at most LISTS) and a pass of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from .access import Scope, matching, readable, searchable
from .search import QUERY_ROWS, Best

LISTS = 64
MOST_LISTS = 4096
#: lists that a query reads first
PROBES = 2
STEPS = 2
#: distances held at once
DISTANCES = 1 << 20


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and the distance; in blocks of rows, as there may be many centroids."""
    near, own, step = np.zeros(len(x), np.int64), (centroids * centroids).sum(1), max(1, DISTANCES // len(centroids))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        near[a : a + step] = ((part * part).sum(1)[:, None] - 2 * part @ centroids.T + own).argmin(1)
    return near, np.linalg.norm(x - centroids[near], axis=1)


class Index:
    """Lists of passages under a path, with their centroids and radii."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, radius: np.ndarray, size: np.ndarray):
        self.rows, self.centroids, self.radius, self.size = rows, centroids, radius, size


def _usable(passages: DataFrame) -> DataFrame:
    return passages.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull()))


def build(passages: DataFrame, lists: int = LISTS, path: str | None = None) -> Index | None:
    """The index of passages whose vectors have one length; None if there are none.

    Centroids start as the vectors whose ids hash lowest and move to their members' mean
    STEPS times; means are sums of each task's sums. The start is bounded by `lists`.
    """
    if not 0 < lists <= MOST_LISTS:
        raise ValueError(f"lists must be 1 to {MOST_LISTS}")
    own = _usable(passages)
    first = own.select(F.xxhash64("document_id", "chunk_index").alias("key"), "embedding").orderBy("key", "embedding").limit(lists).collect()
    if not first:
        return None
    centroids = np.unique(np.array([r[1] for r in first], np.float64), axis=0)
    dimension = centroids.shape[1]

    def summed(held: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(held), np.zeros(len(held))
            for batch in batches:
                x = _matrix(batch.column(0), dimension)
                near, _ = _nearest(x, held)
                np.add.at(total, near, x)
                n += np.bincount(near, minlength=len(held))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list", "n", "total"])

        return run

    for _ in range(STEPS):
        sums = own.select("embedding").mapInArrow(summed(centroids), "list int, n long, total array<double>")
        parts = sums.select("list", "n", F.posexplode("total").alias("at", "x")).groupBy("list", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        for list_, at, x, n in parts.collect():  # at most lists x dimension rows
            centroids[list_, at] = x / n

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = _nearest(_matrix(batch.column(batch.schema.get_field_index("embedding")), dimension), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(near.astype(np.int32))], names=[*batch.schema.names, "distance", "list"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", distance double, list int"
    path = path or shared.fresh(passages.sparkSession, "vector-index")
    placed = own.mapInArrow(dealt, kinds).repartition(F.col("list"))
    placed.sortWithinPartitions("list", "document_id", "chunk_index").write.partitionBy("list").parquet(path)
    rows = passages.sparkSession.read.schema(placed.schema).parquet(path)
    radius, size = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for list_, far, n in rows.groupBy("list").agg(F.max("distance"), F.count("*")).collect():
        radius[list_], size[list_] = far, n
    return Index(rows.drop("distance"), centroids, radius, size)


def _scored(index: Index, wanted: dict[int, np.ndarray], ids: list, q: np.ndarray, allowed: DataFrame, k: int, digits: int) -> DataFrame:
    """(query_id, document_id, chunk_index, score): each query's k best of a batch, in the lists that it wants."""
    dimension = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(q, k, digits)
        for batch in batches:
            batch = batch.sort_by([("list", "ascending"), ("document_id", "ascending"), ("chunk_index", "ascending")])
            of, x = batch.column(3).to_numpy(), _matrix(batch.column(2), dimension)
            for list_, first, n in zip(*(v.tolist() for v in np.unique(of, return_index=True, return_counts=True))):
                best.meet(wanted[list_], x[first : first + n], batch.column(0).slice(first, n), batch.column(1).slice(first, n))
        yield from best.batches(pa.array(ids, pa.int64()))

    kinds = dict(allowed.dtypes)
    scan = allowed.where(F.col("list").isin(sorted(wanted))).select("document_id", "chunk_index", "embedding", "list")
    found = scan.mapInArrow(run, f"query_id long, document_id {kinds['document_id']}, chunk_index {kinds['chunk_index']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _wanted(pairs: np.ndarray) -> dict[int, np.ndarray]:
    """The queries (rows) of each list (columns)."""
    return {int(c): np.flatnonzero(pairs[:, c]) for c in np.flatnonzero(pairs.any(0))}


def search(index: Index, queries: DataFrame, k: int, filters: dict[str, str | None] | None = None, scope: Scope | None = None, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """The k best passages of each query (query_id, q), and (query_id, lists, lists_read, rows_read).

    Equal to a scan: scores are rounded, ties go by document and index. Queries come in
    passes of QUERY_ROWS, with a table after each.
    """
    spark = queries.sparkSession
    allowed = index.rows.where(searchable() & matching(filters or {}) & readable(scope))
    own = queries.where("query_id IS NOT NULL AND q IS NOT NULL").where(F.size("q") == index.centroids.shape[1])
    passes = max(1, -(-own.count() // QUERY_ROWS))
    results, reads = [], []
    for p in range(passes):
        rows = own.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).select(F.col("query_id").cast("long"), "q").collect()
        if not rows:
            continue
        ids, q = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
        slack = 10.0**-digits + 1e-9
        bound = q @ index.centroids.T + np.linalg.norm(q, axis=1)[:, None] * index.radius + slack
        bound[:, index.size == 0] = -np.inf
        probed = np.zeros(bound.shape, bool)
        first = np.argsort(-bound, axis=1, kind="stable")[:, :PROBES]
        np.put_along_axis(probed, first, True, 1)
        probed &= np.isfinite(bound)
        one = shared.written(_scored(index, _wanted(probed), ids, q, allowed, k, digits), "probed")
        least = {r[0]: r[1] for r in one.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}  # a row a query of the pass
        needed = ~probed & (bound >= np.array([least.get(i, -np.inf) for i in ids])[:, None]) & np.isfinite(bound)
        results.append(one)
        if needed.any():
            results.append(shared.written(_scored(index, _wanted(needed), ids, q, allowed, k, digits), "needed"))
        read = probed | needed
        reads.append(spark.createDataFrame([(i, len(index.size), int(r.sum()), int(index.size[r].sum())) for i, r in zip(ids, read)], "query_id long, lists int, lists_read int, rows_read long"))
    if not results:
        empty = allowed.limit(0).select(F.lit(0).cast("long").alias("query_id"), "document_id", "chunk_index", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return empty, spark.createDataFrame([], "query_id long, lists int, lists_read int, rows_read long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    found = reduce(DataFrame.unionByName, results).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found, reduce(DataFrame.unionByName, reads)
