"""Filtered exact vector search over passages: matrix products of blocks, k rows a query and task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import dot
from ..sources import shared
from .access import Scope, matching, readable, searchable

#: rows of queries that a pass hands to every task: of an index's search, and of a scan
QUERY_ROWS, SCAN_ROWS = 10_000, 40_000
BLOCK, QUERY_BLOCK = 2048, 256


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.where(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull()))


class Best:
    """The k best rows of each query among those that a task meets, by rounded inner product, ties by document and index.

    Products of blocks are taken in single precision; what may be among the best by them, with
    their greatest error allowed for, is scored again in double. A query's least score so far
    keeps most of a later block out. Held are k rows a query and as many not yet put in order.
    """

    def __init__(self, q: np.ndarray, k: int, digits: int):
        self.q, self.k, self.digits = q, k, digits
        self.single, self.norm = q.astype(np.float32), np.linalg.norm(q, axis=1)
        self.least = np.full(len(q), -np.inf)
        self.parts: list[pa.Table] = []
        self.pending = 0

    def meet(self, asking: np.ndarray, c: np.ndarray, document: pa.Array, index: pa.Array) -> None:
        """Some queries (by place) meet rows that stand in the order of document and index."""
        for a in range(0, len(c), BLOCK):
            rows = c[a : a + BLOCK]
            single, far = rows.astype(np.float32).T, np.linalg.norm(rows, axis=1).max()
            for b in range(0, len(asking), QUERY_BLOCK):
                own = asking[b : b + QUERY_BLOCK]
                near = self.single[own] @ single
                slack = (c.shape[1] + 4) * 2.0**-23 * self.norm[own] * far + 10.0**-self.digits
                low = self.least[own] - slack
                if len(rows) > self.k and np.isneginf(low).any():
                    low = np.fmax(low, np.partition(near, len(rows) - self.k, axis=1)[:, len(rows) - self.k] - 2 * slack)
                of, at = np.nonzero(~(near < low[:, None]))
                if len(of):
                    self._keep(own[of], rows, at, document.slice(a, len(rows)), index.slice(a, len(rows)))

    def _keep(self, of: np.ndarray, rows: np.ndarray, at: np.ndarray, document: pa.Array, index: pa.Array) -> None:
        step = 1 << 15
        score = np.concatenate([np.round(np.einsum("ij,ij->i", self.q[of[x : x + step]], rows[at[x : x + step]]), self.digits) for x in range(0, len(of), step)])
        order = np.lexsort((at, -score, of))
        of, at, score = of[order], at[order], score[order]
        place = _places(of)
        last = place == self.k - 1
        self.least[of[last]] = np.fmax(self.least[of[last]], score[last])
        kept = (place < self.k) & ~(score < self.least[of])
        where = pa.array(at[kept])
        self.parts.append(pa.table({"query": of[kept], "score": score[kept], "document_id": document.take(where), "chunk_index": index.take(where)}))
        self.pending += int(kept.sum())
        if self.pending > max(1 << 17, len(self.q) * self.k):
            self.found()

    def found(self) -> pa.Table:
        """(query, score, document_id, chunk_index), k rows a query."""
        if self.parts:
            held = pa.concat_tables(self.parts).combine_chunks()
            held = held.sort_by([("query", "ascending"), ("score", "descending"), ("document_id", "ascending"), ("chunk_index", "ascending")])
            of, score = held["query"].to_numpy(), held["score"].to_numpy()
            place = _places(of)
            last = place == self.k - 1
            self.least[of[last]] = np.fmax(self.least[of[last]], score[last])
            self.parts, self.pending = [held.take(pa.array(np.flatnonzero(place < self.k)))], 0
        return self.parts[0] if self.parts else pa.table({"query": pa.array([], pa.int64())})

    def batches(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query_id, document_id, chunk_index, score), with the queries' ids."""
        found = self.found()
        for part in found.to_batches(BLOCK * 4) if found.num_rows else []:
            yield pa.RecordBatch.from_arrays([ids.take(part["query"]), part["document_id"], part["chunk_index"], part["score"]], names=["query_id", "document_id", "chunk_index", "score"])


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group, where groups stand together."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def matrices(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length among vectors."""
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        yield dim, own, flat[first[own][:, None] + np.arange(dim)]


def vector_topk(passages: DataFrame, queries: DataFrame, k: int, filters: dict[str, str | None] | None = None, scope: Scope | None = None, digits: int = 6) -> DataFrame:
    """The k best passages of each query (query_id, q), by rounded inner product, ties by document and index.

    The filter and the access predicate stand below the scan. Any number of queries: they
    are broadcast in passes of about SCAN_ROWS. A task gives k rows a query, and only these
    are exchanged; the passages' other columns join the ones that are left.
    A passage is named by document_id and chunk_index.
    """
    spark = passages.sparkSession
    allowed = passages.where(searchable() & matching(filters or {}) & readable(scope))
    asked = _usable(queries, "q").select("query_id", "q")
    passes = max(1, -(-asked.count() // SCAN_ROWS))
    # dealt to all cores, as the work is the products and not the bytes
    rows = _usable(allowed, "embedding").select("document_id", "chunk_index", "embedding").repartition(spark.sparkContext.defaultParallelism)
    if passes > 1:  # dealt once, and a table after each pass, so that one broadcast lives at a time
        asked, rows = shared.written(asked, "asked"), shared.written(rows, "rows")
    kinds = [(c, t) for df, names in ((queries, ["query_id"]), (passages, ["document_id", "chunk_index"])) for c in names for t in [df.schema[c].dataType.simpleString()]]
    schema = ", ".join(f"{c} {t}" for c, t in kinds) + ", score double"
    met = []
    for n in range(passes):
        given = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).toArrow().combine_chunks()
        if not given.num_rows:
            continue
        sent = spark.sparkContext.broadcast(given)

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids = sent.value["query_id"].combine_chunks()
            by_length = {dim: (ids.take(pa.array(own)), Best(q, k, digits)) for dim, own, q in matrices(sent.value["q"].combine_chunks())}
            for batch in batches:
                batch = batch.sort_by([("document_id", "ascending"), ("chunk_index", "ascending")])
                for dim, own, c in matrices(batch.column(2)):
                    if dim in by_length:
                        held, at = by_length[dim][1], pa.array(own)
                        held.meet(np.arange(len(held.q)), c, batch.column(0).take(at), batch.column(1).take(at))
            for of, held in by_length.values():
                yield from held.batches(of)

        found = rows.mapInArrow(best, schema)
        met.append(shared.written(found, "pass") if passes > 1 else found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    found = (reduce(DataFrame.unionByName, met) if met else spark.createDataFrame([], schema)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    others = allowed.drop(*[c for c in ("embedding", "query_id", "score", "rank") if c in allowed.columns])
    return found.join(others, ["document_id", "chunk_index"])


def single_topk(passages: DataFrame, vector: list[float], k: int, filters: dict[str, str | None] | None = None, scope: Scope | None = None, digits: int = 6) -> DataFrame:
    """One query: a plain ordered limit, which runs as a distributed top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    allowed = passages.where(searchable() & matching(filters or {}) & readable(scope))
    scored = allowed.withColumn("score", F.round(dot(F.col("embedding"), q), digits)).drop("embedding")
    return scored.orderBy(F.desc("score"), "document_id", "chunk_index").limit(k)


def check_dimension(passages: DataFrame, dimension: int) -> DataFrame:
    """The passages, failing at run time on a vector of another length."""
    return passages.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} numbers, found "), F.size("embedding").cast("string")))))


def describe(passages: DataFrame) -> DataFrame:
    """Rows, documents, dimension and columns of a passage table."""
    return passages.agg(F.count("*").alias("points"), F.countDistinct("document_id").alias("documents"), F.max(F.size("embedding")).alias("dimension"))


def list_passages(passages: DataFrame, document_id: object, offset: int, limit: int) -> DataFrame:
    """One document's passages in order, a window of them, with the document's total on each row."""
    own = passages.where(F.col("document_id") == document_id)
    counted = own.withColumn("total", F.count("*").over(Window.partitionBy("document_id")))
    return counted.orderBy("chunk_index").offset(offset).limit(limit)
