"""Sequence packing: shortest pack first over the length histogram.

Documents are tokenised once into a shared table. A document's whole multiples
of the sequence length fill sequences of their own; what remains is packed by
length, longest first, into the pack with the most room (the shortest so far).
Packs with equal contents are one pattern with a count, so the plan's size
follows the number of distinct lengths, never that of documents. When as many
packs are open as the tokens need, a length that fits nowhere is cut at the
largest room and its rest goes on as a shorter one: padding stays below one
sequence for the whole corpus. The plan gives ranges of ranks within a length;
documents get their rank from a count per task plus a running total over tasks.

Defined results: a null text is an empty one, whose only id is the end id; every
document, repeated rows too, has at least one piece; an empty table gives an
empty result. Only the two named columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens
from .carry import named

SIZE = 2048
END = 1
#: the table of rank bases is broadcast up to so many rows, joined by shuffle beyond
BROADCAST_ROWS = 400_000

TOKENS = "part int, doc_id long, ids binary, n long, rest int, full_rank long, rest_rank long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, vocabulary: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: its ids with the end id, and its ranks within its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = tokens.word_bpe(vocabulary), TaskContext.get().partitionId()
        seen, full = np.zeros(size, np.int64), 0
        end = np.array([END], "<u2").tobytes()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ids, room = [], 8 << 20
                for text in batch.column(1).slice(at, 2000):
                    ids.append(bpe.encode(text.as_py()) + end)
                    room -= len(ids[-1])
                    if room < 0:
                        break
                n = np.array([len(x) // 2 for x in ids], np.int64)
                rest, fulls = (n % size).astype(np.int32), n // size
                ranks = np.empty(len(n), np.int64)
                for k, r in enumerate(rest.tolist()):
                    ranks[k] = seen[r]
                    seen[r] += 1
                before = full + np.cumsum(fulls) - fulls
                full += int(fulls.sum())
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part, np.int32)), batch.column(0).slice(at, k), pa.array(ids, pa.binary()), pa.array(n), pa.array(rest), pa.array(before), pa.array(ranks)],
                    names=["part", "doc_id", "ids", "n", "rest", "full_rank", "rest_rank"],
                )
                at += k

    own = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))
    return scratch.table(own.mapInArrow(run, TOKENS), "tokens")


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Placements (length, first rank, last rank + 1, start in the rest, taken, first pack, offset)."""
    packs = -(-sum(k * c for k, c in histogram.items()) // size)
    pending: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for length, count in histogram.items():
        if length > 0 and count > 0:
            pending[length].append((length, 0, count, 0))
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    heap: list[int] = []

    def give(room: int, first: int, last: int) -> None:
        if room > 0:
            if not rooms[room]:
                heapq.heappush(heap, -room)
            rooms[room].append((first, last))

    out, opened = [], 0
    for length in range(size, 0, -1):
        while pending[length]:
            origin, r0, r1, start = pending[length].pop()
            while r0 < r1:
                while heap and not rooms[-heap[0]]:
                    heapq.heappop(heap)
                room = -heap[0] if heap else 0
                if room < length and opened < packs:
                    k = min(r1 - r0, packs - opened)
                    out.append((origin, r0, r0 + k, start, length, opened, 0))
                    give(size - length, opened, opened + k)
                    opened += k
                else:
                    first, last = rooms[room].pop()
                    k = min(r1 - r0, last - first)
                    taken = min(room, length)
                    out.append((origin, r0, r0 + k, start, taken, first, size - room))
                    if first + k < last:
                        rooms[room].append((first + k, last))
                    give(room - taken, first, first + k)
                    if taken < length:
                        pending[length - taken].append((origin, r0, r0 + k, start + taken))
                r0 += k
    return out


class Placements:
    """The plan as sorted intervals of (length, rank), for look-up by array."""

    def __init__(self, placed: list[tuple[int, int, int, int, int, int, int]]):
        cuts: dict[int, set[int]] = defaultdict(set)
        for origin, r0, r1, *_ in placed:
            cuts[origin] |= {r0, r1}
        self.edges = {k: np.array(sorted(v), np.int64) for k, v in cuts.items()}
        self.of: dict[int, list[list[tuple[int, int, int, int]]]] = {k: [[] for _ in v] for k, v in self.edges.items()}
        for origin, r0, r1, start, taken, pack, offset in placed:
            edges = self.edges[origin]
            for j in range(int(np.searchsorted(edges, r0)), int(np.searchsorted(edges, r1))):
                self.of[origin][j].append((start, taken, pack - r0, offset))
        for lists in self.of.values():
            for x in lists:
                x.sort()

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, tokens, pack, offset) of each piece of the document with this rank."""
        j = int(np.searchsorted(self.edges[length], rank, "right")) - 1
        return [(s, t, pack + rank, o) for s, t, pack, o in self.of[length][j]]


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row a piece (PIECES), with its token ids as 16-bit integers when ids is set."""
    rows = tokenised(docs, vocabulary or tokens.default_vocabulary(), size, id_col, text_col)
    rests = rows.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("k"))
    fulls = rows.groupBy("part").agg(F.sum(F.expr(f"n div {size}")).alias("k")).select("part", F.lit(0).alias("rest"), "k")
    counts = scratch.table(rests.unionByName(fulls), "lengths")
    totals = {r["rest"]: r["k"] for r in counts.groupBy("rest").agg(F.sum("k").alias("k")).collect()}
    whole = totals.pop(0, 0) or 0
    placed = Placements(plan(totals, size))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "rest", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    of_rest = bases.withColumnRenamed("base", "rest_base")
    of_full = bases.where("rest = 0").select("part", F.col("base").alias("full_base"))
    if counts.count() <= BROADCAST_ROWS:
        of_rest, of_full = F.broadcast(of_rest), F.broadcast(of_full)
    based = rows.join(of_full, "part").join(of_rest, ["part", "rest"]).select(
        "doc_id", "ids", "n", "rest", (F.col("full_rank") + F.col("full_base")).alias("full_rank"), (F.col("rest_rank") + F.col("rest_base")).alias("rest_rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            of: list[int] = []
            cuts: list[bytes] = []
            n, rest, full, rank = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            for d in range(batch.num_rows):
                own = np.frombuffer(batch.column(1)[d].as_buffer(), "<u2")
                head = n[d] - rest[d]
                pieces = [(k * size, size, full[d] + k, 0) for k in range(head // size)]
                if rest[d]:
                    pieces += [(head + s, t, whole + p, o) for s, t, p, o in placed.pieces(rest[d], rank[d])]
                for start, length, sequence, offset in pieces:
                    piece = own[start : start + length]
                    made.append((start, length, zlib.crc32(piece.astype("<u4").tobytes()), n[d], sequence, offset))
                    of.append(d)
                    if ids:
                        cuts.append(piece.tobytes())
            columns = list(zip(*made)) or [()] * 6
            arrays = [batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                arrays.append(pa.array(cuts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return based.mapInArrow(run, PIECES + (", ids binary" if ids else ""))


def read_sequence(pieces: list[tuple[int, bytes]], size: int = SIZE, pad: int = 0) -> np.ndarray:
    """A sequence's ids from its pieces (offset, ids), padded to size unless its length is a power of two."""
    flat = np.concatenate([np.frombuffer(x, "<u2") for _, x in sorted(pieces)] or [np.empty(0, "<u2")])
    n = len(flat)
    return flat if n and n & (n - 1) == 0 else np.pad(flat, (0, size - n), constant_values=pad)
