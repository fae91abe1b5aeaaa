"""Cross-entropy difference between matched target and background bigram models.

Both models have one vocabulary (every word of target and background, and one place
for a word never seen), the same order and the same interpolation; the target model
is counted on the target documents, the background model on all others. They are
matched in size, too: the background's counts are scaled to as many words as the
target has, as in a sample of that size, so that a count added for smoothing weighs
the same in both. A document is scored by what the others have: its own counts are
taken out of the model it was counted in. The score is the mean over its words of
the target model's loss less the background model's: the lower, the more it reads
like the target.

A task's texts make chunks of a bounded size; words become ids of a chunk's own list of
words, written once. A chunk sends its distinct words, and then its distinct bigrams,
with their counts, packed, to ranges; a range adds them up over all chunks and sends
every chunk the sums of its own, from which the chunk takes the losses. There are as many
ranges as the words need, so that none is sent more than a bounded number of keys. What travels
grows with the text, less than in proportion while chunks are small, and is never at
one place; only the numbers of words reach the driver. Words and bigrams are told
apart by 64 hash bits.

Defined results: null and empty texts have no words and score 0. Where a model has
no document but the one that is scored, it is uniform; without target documents or
without others nothing is scaled. A document is a target if its id is among
the targets; repeated rows count repeatedly. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .carry import named
from .textscan import ALNUM, mix, scan, slices

#: stands before a document's first word; no word has this hash
OPEN = np.uint64(0)
MIXTURE = 0.7
#: a task's texts are scanned in slices of a quarter of this, which make chunks; a longer text is one by itself
CHUNK_BYTES = 8 << 20
#: keys that all chunks together send to one range, some 100 bytes of its task each
RANGE_KEYS = 4_000_000
BROADCAST_ROWS = 1_000_000


def _packed(*arrays: np.ndarray) -> bytes:
    """Columns of whole numbers, bytes of one weight together: the high ones are mostly zero."""
    return zlib.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays), 1)


def _unpacked(blob, *kinds: str) -> list[np.ndarray]:
    flat, width = np.frombuffer(zlib.decompress(blob), np.uint8), [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(flat) // sum(width), [], 0
    for kind, w in zip(kinds, width):
        out.append(np.ascontiguousarray(flat[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, docs, words, ids, names, n): up to chunk_bytes of a task's documents as ids; docs holds each one's id, presence, target mark and words, words the sorted hashes that ids count, OPEN first. names and n are the numbers of words and of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def chunk() -> pa.RecordBatch:
            nonlocal at, size
            words = np.unique(np.concatenate([w for _, w, _ in held]))
            ids = np.concatenate([np.searchsorted(words, w).astype("<u4")[i] for _, w, i in held])
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate([h for h, _, _ in held]), words.astype("<u8"), ids)]
            held.clear()
            at, size = at + 1, 0
            counts = [pa.array([len(x)], pa.int64()) for x in (words, ids)]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + at], pa.int64()), *blobs, *counts], names=["chunk", "docs", "words", "ids", "names", "n"])

        for batch in batches:
            for own in slices(batch, "text", max(1, chunk_bytes // 4)):
                w = scan(own.column(1), ALNUM)
                if held and size + len(w.buf) > chunk_bytes:
                    yield chunk()
                words, ids = np.unique(np.concatenate([[OPEN], np.maximum(w.hash, OPEN + np.uint64(1))]), return_inverse=True)
                present = np.asarray(own.column(0).is_valid())
                name = np.asarray(own.column(0).fill_null(0))
                target = np.asarray(own.column(2))
                held.append((np.stack([name, present, target, np.diff(w.first())], 1).astype("<i8"), words, ids[1:].astype("<u4")))
                size += len(w.buf)
        if held:
            yield chunk()

    return scratch.table(docs.mapInArrow(run, "chunk long, docs binary, words binary, ids binary, names long, n long"), "chunks")


def _bigrams(docs, words, ids) -> tuple[np.ndarray, ...]:
    """Documents' heads, hashes of the words, each word's document, whether it is a target's, the id before it and its own."""
    head, name = np.frombuffer(docs, "<i8").reshape(-1, 4), np.frombuffer(words, "<u8")
    now = np.frombuffer(ids, "<u4")
    of = np.repeat(np.arange(len(head)), head[:, 3])
    before = np.empty_like(now)
    before[1:] = now[:-1]
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    before[first] = 0
    return head, name, of, head[of, 2].astype(bool), before, now


def _distinct(name: np.ndarray, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the distinct bigrams, and each word's place among them."""
    return np.unique(mix(name[before] * np.uint64(0x9E3779B97F4A7C15) + name[now]), return_inverse=True)


def _sent(chunk: int, key: np.ndarray, counts: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """A chunk's sorted keys and their counts, a row for each range."""
    to = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cut = np.searchsorted(to, np.arange(ranges + 1))
    full = [r for r in range(ranges) if cut[r + 1] > cut[r]]
    blobs = [_packed(np.diff(key[cut[r] : cut[r + 1]], prepend=np.uint64(0)), *(c[cut[r] : cut[r + 1]].astype("<u4") for c in counts)) for r in full]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(full), chunk, np.int64)), pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "range", "blob"])


def _added(counts: int) -> Callable[[pa.Table], pa.Table]:
    """Sums of a range's counts over all chunks, for each chunk those of its own keys; the first row has the number of keys but OPEN and the sums of all counts."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_buffer(), "<u8", *["<u4"] * counts) for x in table["blob"].combine_chunks()]
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = [np.bincount(at, np.concatenate([p[k] for p in parts])).astype("<u8") for k in range(1, counts + 1)]
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        blobs = [_packed(*(t[at[a:b]] for t in total)) for a, b in zip(cut[:-1], cut[1:])]
        sums = [[int((found != OPEN).sum()), *(int(t.sum()) for t in total)], *[None] * (len(keys) - 1)]
        return pa.table({"chunk": table["chunk"], "range": table["range"], "blob": pa.array(blobs, pa.binary()), "sums": pa.array(sums, pa.list_(pa.int64()))})

    return run


def _joined(blobs: pa.ListScalar, counts: int) -> list[np.ndarray]:
    """The sums of all of a chunk's keys, in their order."""
    parts = [_unpacked(x.as_buffer(), *["<u8"] * counts) for x in blobs.values] if blobs.is_valid else []
    return [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64) for k in range(counts)]


def _in_document(of: np.ndarray, at: np.ndarray, among: np.ndarray) -> np.ndarray:
    """How often each place's number occurs in its own document, among the documents marked; 0 in others."""
    key = of * (int(at.max()) + 1) + at
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return np.where(among, count[back], 0)


def _loss(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: np.ndarray, weight: float, size: int) -> np.ndarray:
    """The loss of each bigram in one model, whose counts are weighted by `weight` where one is added to them."""
    flat = (weight * word + 1.0) / (weight * total + size)
    return -np.log(np.where(context > 0, MIXTURE * pair / np.maximum(context, 1) + (1 - MIXTURE) * flat, flat))


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, is_target, score. targets: a column of ids named id_col."""
    own = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))
    names = targets.select(F.col(named(id_col)).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    names = scratch.table(names, "targets")
    if names.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    chunks = _chunks(own.join(names, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")), chunk_bytes)
    word_ranges, pair_ranges = (max(8, -(-(n or 0) // RANGE_KEYS)) for n in chunks.agg(F.sum("names"), F.sum("n")).first())
    chunks = chunks.drop("names", "n")

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *blobs in zip(batch.column(0).to_pylist(), *batch.columns[1:4]):
                _, name, _, target, before, now = _bigrams(*(x.as_buffer() for x in blobs))
                if len(now):
                    counts = [np.bincount(x, minlength=len(name)) for x in (now[target], now[~target], before[target], before[~target])]
                    yield _sent(chunk, name, counts, word_ranges)

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *blobs in zip(batch.column(0).to_pylist(), *batch.columns[1:4]):
                _, name, _, target, before, now = _bigrams(*(x.as_buffer() for x in blobs))
                if len(now):
                    found, at = _distinct(name, before, now)
                    counts = [np.bincount(at[own], minlength=len(found)) for own in (target, ~target)]
                    yield _sent(chunk, found, counts, pair_ranges)

    def added(sent, counts: int) -> DataFrame:
        rows = chunks.mapInArrow(sent, "chunk long, range int, blob binary")
        return rows.groupBy("range").applyInArrow(_added(counts), "chunk long, range int, blob binary, sums array<long>")

    words = scratch.table(added(of_words, 4), "words")
    size, *total = (n or 0 for n in words.agg(*[F.sum(F.col("sums")[k]) for k in range(3)]).first())
    size += 1
    weight = (1.0, total[0] / total[1] if all(total[:2]) else 1.0)

    def of_kind(pairs: bool) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("pairs") == pairs, F.struct("range", "blob")))), lambda x: x["blob"])

    back = words.withColumn("pairs", F.lit(False)).unionByName(added(of_pairs, 2).withColumn("pairs", F.lit(True)))
    gathered = back.groupBy("chunk").agg(of_kind(False).alias("of_words"), of_kind(True).alias("of_pairs"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_, words_, ids, sums, pairs in zip(*batch.columns[:5]):
                head, name, of, _, before, now = _bigrams(docs_.as_buffer(), words_.as_buffer(), ids.as_buffer())
                before, now = before.astype(np.int64), now.astype(np.int64)
                n, mean = head[:, 3], np.zeros(len(head))
                if len(now):
                    found, at = _distinct(name, before, now)
                    every, every_pair = _joined(sums, 4), _joined(pairs, 2)
                    inside, loss = head[of, 2] == 1, []
                    for side, among in enumerate((inside, ~inside)):
                        pair = every_pair[side][at] - _in_document(of, at, among)
                        context = every[2 + side][before] - _in_document(of, before, among)
                        word = every[side][now] - _in_document(of, now, among)
                        loss.append(_loss(pair, context, word, total[side] - np.where(among, n[of], 0), weight[side], size))
                    mean = np.bincount(of, loss[0] - loss[1], minlength=len(head)) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([pa.array(head[:, 0], mask=head[:, 1] == 0), pa.array(n), pa.array(head[:, 2] == 1), pa.array(mean)], names=["doc_id", "n_words", "is_target", "score"])

    return chunks.join(gathered, "chunk", "left").select("docs", "words", "ids", "of_words", "of_pairs").mapInArrow(scored, "doc_id long, n_words long, is_target boolean, score double")
