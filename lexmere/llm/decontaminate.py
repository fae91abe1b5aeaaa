"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents with a bounded number of bytes. Its words are
coded with the vocabulary of the benchmark; other words end a run, and runs
shorter than the shortest window cannot hold one and are left out. All windows
of the benchmark are searched backwards at once, their occurrences are located
from sampled suffix positions, and overlapping occurrences merge into spans.

Defined results: a null or empty text has no words, no hits and stays as it is.
Items without words, and items with a null id, have no window. Repeated items
count once for an id. An empty benchmark leaves every document clean. Only the
two named columns of each input are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .carry import with_rest
from .fmindex import FMIndex
from .textscan import ALNUM, Words, scan, slices

SHARD_BYTES = 4 << 20
#: a pass over the documents searches so many bytes of benchmark; a larger benchmark takes more passes
BLOCK_BYTES = 16 << 20
#: what the passes have found is broadcast up to so many bytes, joined by shuffle beyond
BROADCAST_BYTES = 32 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, clean string"


@dataclass
class Windows:
    """The distinct windows of a benchmark block, right-aligned codes, with their items."""

    vocabulary: np.ndarray
    codes: np.ndarray
    length: np.ndarray
    items: list[str]
    item_of: np.ndarray
    item_from: np.ndarray

    @staticmethod
    def of(items: list[tuple[str, str]], size: int) -> "Windows":
        words = scan(pa.array([t for _, t in items], pa.large_string()), ALNUM)
        vocabulary = np.unique(words.hash)
        code = np.searchsorted(vocabulary, words.hash) + 1
        first = words.first()
        names = sorted({i for i, _ in items})
        at = {x: k for k, x in enumerate(names)}
        owners: dict[bytes, set[int]] = {}
        for k, (name, _) in enumerate(items):
            own = code[first[k] : first[k + 1]].astype(np.int32)
            for j in range(max(1, len(own) - size + 1) if len(own) else 0):
                owners.setdefault(own[j : j + size].tobytes(), set()).add(at[name])
        keys = sorted(owners)
        codes, length = np.zeros((len(keys), size), np.int32), np.zeros(len(keys), np.int64)
        for k, x in enumerate(keys):
            w = np.frombuffer(x, np.int32)
            codes[k, size - len(w) :], length[k] = w, len(w)
        lists = [sorted(owners[x]) for x in keys]
        item_from = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return Windows(vocabulary, codes, length, names, np.array([y for x in lists for y in x], np.int64), item_from)


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of count integers from start: the row of each and the integers."""
    row = np.repeat(np.arange(len(start)), count)
    return row, start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def search_shard(words: Words, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words of a shard, and the distinct (document, item) pairs."""
    hit, none = np.zeros(len(words.start), bool), np.empty(0, np.int64)
    if not len(w.codes) or not len(words.start):
        return hit, none, none
    near = np.minimum(np.searchsorted(w.vocabulary, words.hash), len(w.vocabulary) - 1)
    code = np.where(w.vocabulary[near] == words.hash, near + 1, 0)
    known = code > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1] | (words.doc[1:] != words.doc[:-1])
    begin = np.flatnonzero(opens)
    if not len(begin):
        return hit, none, none
    closes = known.copy()
    closes[:-1] &= ~known[1:] | (words.doc[1:] != words.doc[:-1])
    span = np.flatnonzero(closes) + 1 - begin
    long = span >= int(w.length.min())
    begin, span = begin[long], span[long]
    if not len(begin):
        return hit, none, none
    run, place = _expand(begin, span)
    text = np.zeros(len(run) + len(begin), np.int64)
    slot = np.arange(len(run)) + run
    text[slot] = code[place]
    word_at = np.zeros(len(text), np.int64)
    word_at[slot] = place
    index = FMIndex(text, len(w.vocabulary))
    lo, hi = index.search(w.codes, w.length)
    found = np.flatnonzero(hi > lo)
    which, row = _expand(lo[found], (hi - lo)[found])
    which = found[which]
    word = word_at[index.locate(row)]
    change = np.zeros(len(hit) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + w.length[which], -1)
    hit = np.cumsum(change[:-1]) > 0
    pair = np.unique(words.doc[word] * len(w.codes) + which)
    doc, which = pair // len(w.codes), pair % len(w.codes)
    of, at = _expand(w.item_from[which], (w.item_from[1:] - w.item_from[:-1])[which])
    both = np.unique(doc[of] * len(w.items) + w.item_of[at])
    return hit, both // len(w.items), both % len(w.items)


def _cleaned(raw: bytes, words: Words, hit: np.ndarray, origin: int) -> str:
    """A document's text without its merged spans of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1):
        out.append(raw[at : words.start[a] - origin])
        at = int(words.end[b]) - origin
    return b"".join([*out, raw[at:]]).decode()


def _search(text: pa.Array, windows: Windows) -> tuple[Words, np.ndarray, list[list[str]]]:
    """A shard's words, which of them are hit, and the items found in each document."""
    words = scan(text, ALNUM)
    hit, doc, item = search_shard(words, windows)
    found: list[list[str]] = [[] for _ in range(len(text))]
    for d, i in zip(doc.tolist(), item.tolist()):
        found[d].append(windows.items[i])
    return words, hit, found


def _result(part: pa.RecordBatch, words: Words, hit: np.ndarray, found: list[list[str]], texts: bool) -> pa.RecordBatch:
    n, first = part.num_rows, words.first()
    n_hit = np.bincount(words.doc[hit], minlength=n)
    clean: list[str | None] = [None] * n
    if texts:
        clean = part.column(1).to_pylist()
        for d in np.flatnonzero(n_hit):
            a, b = first[d], first[d + 1]
            own = Words(words.buf, words.off, words.start[a:b], words.end[a:b], words.doc[a:b], words.hash[:0])
            clean[d] = _cleaned(clean[d].encode(), own, hit[a:b], int(words.off[d]))
    kept = [part.column(k) for k, name in enumerate(part.schema.names) if name == "rest"]
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(clean, pa.string()), *kept],
        names=["doc_id", "n_words", "n_hit", "items", "clean", "rest"][: 5 + len(kept)],
    )


def _runner(items: list[tuple[str, str]], size: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows.of(items, size)
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                yield _result(part, *_search(part.column(1), windows), texts)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", texts: bool = True, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids found, sorted), clean (text without the hit spans).

    With carry also rest, a struct of all other columns.

    The benchmark goes to the tasks in blocks of about BLOCK_BYTES, a pass for each;
    the results do not depend on their number.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    own, rest = with_rest(docs, id_col, text_col)
    schema = SCHEMA + (f", rest {rest}" if carry else "")
    own = own if carry else own.drop("rest")
    if blocks == 1:
        rows = [(r[0], r[1]) for r in items.collect()]
        return own.mapInArrow(_runner(rows, window, texts), schema)
    return _in_blocks(own, items, window, blocks, texts, schema)


def _in_blocks(own: DataFrame, items: DataFrame, window: int, blocks: int, texts: bool, schema: str) -> DataFrame:
    """A pass over the texts for each block of items; what is hit in any pass is cut at the end.

    Rows get a number in a table of their own. A pass writes the number, the hit words (as bits) and the
    finds of the documents in which it found something, so it holds one block and its table is small.
    """
    spark = own.sparkSession
    numbered = scratch.table(own.withColumn("at", F.monotonically_increasing_id()), "numbered")

    def hits(part: pa.RecordBatch, words: Words) -> np.ndarray:
        hit, first = np.zeros(len(words.start), bool), words.first()
        for d, passes in enumerate(part.column("bits").to_pylist()):
            for bits in passes or ():
                hit[first[d] : first[d + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=first[d + 1] - first[d]).astype(bool)
        return hit

    def searched(rows):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows.of(rows, window)
            for batch in batches:
                for part in slices(batch, "text", SHARD_BYTES):
                    words, hit, found = _search(part.column(1), windows)
                    first = words.first()
                    met = [(at, np.packbits(hit[a:b]).tobytes(), own) for at, a, b, own in zip(part.column(0).to_pylist(), first[:-1], first[1:], found) if hit[a:b].any()]
                    at, bits, own = zip(*met) if met else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits, pa.binary()), pa.array([list(x) for x in own], pa.list_(pa.string()))], names=["at", "bits", "found"])

        return go

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                words = scan(part.column(1), ALNUM, hashes=False)
                yield _result(part, words, hits(part, words), [sorted(set(x or ())) for x in part.column("found").to_pylist()], texts)

    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    tables = []
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(block == k).collect()]
        if rows:
            tables.append(scratch.table(numbered.select("at", "text").mapInArrow(searched(rows), "at long, bits binary, found array<string>"), f"pass-{k}"))
    found = spark.createDataFrame([], "at long, bits binary, found array<string>")
    for t in tables:
        found = found.unionByName(t)
    met = scratch.table(found.groupBy("at").agg(F.collect_list("bits").alias("bits"), F.flatten(F.collect_list("found")).alias("found")), "passes")
    small = met.agg(F.coalesce(F.sum(F.size("bits") + F.aggregate("bits", F.lit(0), lambda n, b: n + F.octet_length(b)) + F.size("found")), F.lit(0))).first()[0] <= BROADCAST_BYTES
    held = numbered.join(F.broadcast(met) if small else met, "at", "left").drop("at")
    return held.mapInArrow(cut, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts, and a SHA-256 over the sorted ids."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
