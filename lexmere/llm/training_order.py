"""Training-order materialisation: a keyed permutation gives every sequence a slot.

Documents are tokenised, ended with the end id and laid end to end within a scan
task; every `length` ids are a sequence. Sequences count up over the tasks from
0 to N - 1, and a Feistel network with the key permutes these numbers: it works
on the next even power of two, and numbers outside are walked on until they fall
inside, so the slots are again exactly 0 to N - 1. Slots go in ranges to shards,
and shards in ranges to tasks, each to the task of its number.
A shard is one file of records of one fixed stride, in slot order, so a reader
finds slot s in shard s // per_shard at byte (s % per_shard) * stride, and can
stop and go on anywhere. Spark's own writer commits the files, on any store.

A record: slot, sequence number, first document's id and where in it the sequence
begins, ids in use (five little-endian 64-bit integers), the ids (16 bits each,
padded with 0), and a line feed.

Defined results: a null or empty text is one end id; a null doc_id is stored as
the least 64-bit integer; an empty table has no shard. Only the two named columns
are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, tokens
from .carry import named

LENGTH = 2048
END = 1
PER_SHARD = 4096
ROUNDS = 6
HEAD = 40
NULL_ID = -(2**63)
#: shards are written by at most so many tasks, each with a range of them
MOST_TASKS = 20_000


def _round_keys(key: int) -> np.ndarray:
    out, x = [], key & (2**64 - 1)
    for _ in range(ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequence numbers below n: a bijection of 0..n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = _round_keys(key)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for k in keys:
                z = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, at, doc_id, start, n, ids): the sequences of each scan task, numbered within it; written once."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = tokens.word_bpe(vocabulary), TaskContext.get().partitionId()
        end = np.array([END], "<u2").tobytes()
        held, first, at = bytearray(), (0, 0), 0
        made: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            part_, at_, doc, start, n, ids = zip(*made)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(part_, pa.int32()), pa.array(at_, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())], names=["part", "at", "doc_id", "start", "n", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc = doc.as_py()
                doc = NULL_ID if doc is None else doc
                own = memoryview(bpe.encode(text.as_py()) + end)
                done = 0
                while done < len(own):
                    if not held:
                        first = (doc, done // 2)
                    take = min(len(own) - done, 2 * length - len(held))
                    held += own[done : done + take]
                    done += take
                    if len(held) == 2 * length:
                        made.append((part, at, *first, length, bytes(held)))
                        held, at = bytearray(), at + 1
                        if len(made) >= 512:
                            yield batch_of()
        if held:
            made.append((part, at, *first, len(held) // 2, bytes(held)))
        if made:
            yield batch_of()

    own = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))
    return scratch.table(own.mapInArrow(run, "part int, at long, doc_id long, start long, n int, ids binary"), "sequences")


def stride(length: int = LENGTH) -> int:
    return HEAD + 2 * length + 1


def materialise(docs: DataFrame, path: str, key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes the shards under path (shard=K) and returns the number of sequences."""
    rows = sequences(docs, length, vocabulary, id_col, text_col)
    counts = scratch.table(rows.groupBy("part").agg(F.count("*").alias("k")), "counts")
    total = counts.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    # the rows are one a scan task: their running total takes a sort of so many rows and no more
    parts = np.array([tuple(r) for r in counts.orderBy("part").toLocalIterator()], np.int64).reshape(-1, 2)
    names, bases = parts[:, 0], np.cumsum(parts[:, 1]) - parts[:, 1]
    pad = 2 * length
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, MOST_TASKS)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, at, doc, start, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            number = bases[np.searchsorted(names, part)] + at
            slot = permute(number, total, key)
            head = np.stack([slot, number, doc, start, n.astype(np.int64)], 1).astype("<i8")
            made = [zlib.compress(head[k].tobytes() + ids.as_buffer().to_pybytes().ljust(pad, b"\0"), 1) for k, ids in enumerate(batch.column(5))]
            shard = slot // per_shard
            yield pa.RecordBatch.from_arrays([pa.array((shard * tasks // shards).astype(np.int32)), pa.array(shard), pa.array(slot), pa.array(made, pa.binary())], names=["task", "shard", "slot", "record"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([zlib.decompress(x.as_buffer()) for x in own.column(2)], pa.binary())], names=["shard", "slot", "record"])

    ranged = rows.mapInArrow(placed, "task int, shard long, slot long, record binary").repartitionById(tasks, "task")
    raw = ranged.select("shard", "slot", "record").mapInArrow(opened, "shard long, slot long, record binary")
    # the last step before the writer sorts by shard and slot: the writer finds its order and adds no sort of
    # its own, which would keep slots in order only while nothing spills
    in_order = raw.sortWithinPartitions("shard", "slot")
    # a binary cast to a string keeps its bytes, and the text writer adds the line feed
    in_order.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").text(path)
    return total


def records(spark: SparkSession, path: str, length: int = LENGTH, first: int = 0, count: int | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, shard, byte, sequence, doc_id, start, n, ids) read from the shards, from slot `first` on, `count` slots."""
    size = stride(length)
    last = None if count is None else first + count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                n = len(raw) // size
                a = max(0, first - shard * per_shard)
                b = n if last is None else min(n, last - shard * per_shard)
                for k in range(a, b, 512):
                    m = min(b, k + 512)
                    flat = np.frombuffer(raw, np.uint8, (m - k) * size, k * size).reshape(-1, size)
                    head = np.ascontiguousarray(flat[:, :HEAD]).view("<i8")
                    ids = [flat[i, HEAD : HEAD + 2 * int(head[i, 4])].tobytes() for i in range(m - k)]
                    doc = pa.array(head[:, 2], mask=head[:, 2] == NULL_ID)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(head[:, 0]), pa.array(np.full(m - k, shard, np.int64)), pa.array(np.arange(k, m) * size), pa.array(head[:, 1]), doc, pa.array(head[:, 3]), pa.array(head[:, 4]), pa.array(ids, pa.binary())],
                        names=["slot", "shard", "byte", "sequence", "doc_id", "start", "n", "ids"],
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content").where("shard IS NOT NULL")
    files = files.where(F.col("shard") >= first // per_shard)
    if last is not None:
        files = files.where(F.col("shard") <= max(0, last - 1) // per_shard)
    return files.mapInArrow(run, "slot long, shard long, byte long, sequence long, doc_id long, start long, n long, ids binary")


def order(docs: DataFrame, key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The materialised order, read from its shards: all of records() but with the ids' CRC-32 in place of the ids."""
    spark = docs.sparkSession
    path = scratch.place(spark, "shards")
    if not materialise(docs, path, key, length, per_shard, None, id_col, text_col):
        return spark.createDataFrame([], "slot long, shard long, byte long, sequence long, doc_id long, start long, n_tokens long, ids_crc32 long")
    found = records(spark, path, length, per_shard=per_shard)
    return found.select("slot", "shard", "byte", "sequence", "doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
