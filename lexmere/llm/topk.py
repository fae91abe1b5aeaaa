"""Exact top-k inner products with multi-resolution segment statistics.

Vectors become integers, floor(scale * x). At each resolution a vector is cut in
equal segments with a mean and a deviation each. For two vectors the squared
distance is at least the sum over segments of length * ((mean - mean')^2 +
(deviation - deviation')^2); with the known norms that bounds their inner product
from above. A block of candidates is passed coarse to fine: pairs whose bound is
below the query's k-th score so far go, the survivors are computed exactly.

Vectors travel packed, a row a block. The queries are a stated set: their blocks
meet all candidate blocks by broadcast, in passes of about QUERY_BYTES each, so that
candidates are never shuffled. Each pair of blocks yields at most k rows a query,
and these meet in a grouped sort.

Defined results: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id. Rows with the query's own id are the query's
own. Vectors of different lengths do not compare. Ties go to the smaller id;
repeated candidates stand as often as they are there. A query row that repeats
another, id and vector, is asked once; rows of one id with different vectors are
one query, whose finds are ranked together. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .carry import named

BLOCK = 4096
QUERY_BYTES = 32 << 20
QUERY_BLOCK = 512
RESOLUTIONS = (4, 16)
EXACT = 2**52


def packed(vectors: DataFrame, scale: int, block: int) -> DataFrame:
    """Rows (dim, name, ids, vectors): blocks of vectors of one length, as 64-bit integers; name is the block's own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                for a in range(0, len(own), block):
                    at = own[a : a + block]
                    values = np.floor(scale * flat[first[at][:, None] + np.arange(dim)]).astype("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([(part << 32) + made], pa.int64()), pa.array([ids[at].tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["dim", "name", "ids", "vectors"])
                    made += 1

    usable = vectors.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    usable = usable.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return usable.mapInArrow(run, "dim int, name long, ids binary, vectors binary")


def unpack(dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, dim)


class Segments:
    """Means and deviations of each vector at each resolution, weighted by the segments' lengths."""

    def __init__(self, v: np.ndarray):
        x = v.astype(np.float64)
        self.square = (x * x).sum(1)
        self.parts = []
        dim = x.shape[1]
        for m in RESOLUTIONS:
            cut = np.linspace(0, dim, min(m, dim) + 1).astype(int)
            length = np.diff(cut)
            mean = np.add.reduceat(x, cut[:-1], axis=1) / length
            deviation = np.sqrt(np.maximum(np.add.reduceat(x * x, cut[:-1], axis=1) / length - mean * mean, 0))
            self.parts.append(np.concatenate([mean * np.sqrt(length), deviation * np.sqrt(length)], 1))


def upper_bounds(qs: np.ndarray, cs: np.ndarray, q_square: np.ndarray, c_square: np.ndarray) -> np.ndarray:
    """Inner products from the lower-bound distances between segment statistics, every query with every candidate."""
    cross = qs @ cs.T
    least = (qs * qs).sum(1)[:, None] + (cs * cs).sum(1)[None, :] - 2 * cross
    return (q_square[:, None] + c_square[None, :] - np.maximum(least, 0)) / 2


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and the ids and scores of the block's k best, found exactly."""
    reach = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    exact = reach < EXACT
    by = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[by], c[by]
    qs, cs = Segments(q), Segments(c)
    slack = 1 + 1e-9 * (qs.square[:, None].max() + cs.square.max())
    coarse = upper_bounds(qs.parts[0], cs.parts[0], qs.square, cs.square) + slack
    coarse[q_ids[:, None] == c_ids[None, :]] = -np.inf
    cf, qf = (c.astype(np.float64), q.astype(np.float64)) if exact else (c, q)
    probe = min(len(c), max(4 * k, 32))
    for i in range(len(q)):
        bound = coarse[i]
        first = np.argpartition(-bound, probe - 1)[:probe] if probe < len(c) else np.arange(len(c))
        first = first[np.isfinite(bound[first])]
        score = cf[first] @ qf[i]
        limit = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
        left = np.flatnonzero(bound >= limit) if np.isfinite(limit) else np.flatnonzero(np.isfinite(bound))
        if len(left) > probe:
            fine = upper_bounds(qs.parts[1][i : i + 1], cs.parts[1][left], qs.square[i : i + 1], cs.square[left])[0] + slack
            left = left[fine >= limit]
        score = cf[left] @ qf[i]
        top = np.lexsort((left, -score))[:k]
        yield i, c_ids[left[top]], score[top].astype(np.int64)


FOUND = "query_id long, vec_id long, score long"


def _rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(x), i, np.int64) for i, x, _ in found] or [np.empty(0, np.int64)])
    x = np.concatenate([x for _, x, _ in found] or [np.empty(0, np.int64)])
    s = np.concatenate([s for _, _, s in found] or [np.empty(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(s)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors for each row of queries, both with id and vector columns."""

    def own(df: DataFrame) -> DataFrame:
        return df.select(F.col(named(id_col)).cast("long").alias("id"), F.col(named(vector_col)).cast("array<double>").alias("v"))

    asked = scratch.table(packed(own(queries).distinct(), scale, QUERY_BLOCK), "queries")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("vectors") + F.octet_length("ids")), F.lit(0))).first()[0]
    blocks = packed(own(vectors), scale, BLOCK)
    # half of QUERY_BYTES on average, as blocks are dealt by a hash of their number
    passes = 1 if size <= QUERY_BYTES else 2 * -(-size // QUERY_BYTES)
    if passes > 1:
        blocks = scratch.table(blocks, "vectors")
    numbered = asked.select("dim", F.pmod(F.xxhash64("name"), F.lit(passes)).alias("pass"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, values, q_ids, q_values in zip(*(batch.column(j).to_pylist() for j in range(5))):
                c_ids, c = unpack(dim, ids, values)
                a, q = unpack(dim, q_ids, q_values)
                yield _rows([(int(a[i]), x, s) for i, x, s in best_of_block(a, q, c_ids, c, k)])

    def searched(n: int) -> DataFrame:
        met = blocks.join(F.broadcast(numbered.where(F.col("pass") == n)), "dim").select("dim", "ids", "vectors", "q_ids", "q_vectors")
        return met.mapInArrow(run, FOUND)

    found = searched(0)
    if passes > 1:  # a pass is over, and its broadcast with it, before the next begins
        found = reduce(DataFrame.unionByName, [scratch.table(_best(searched(n), k), "found") for n in range(passes)])
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
