"""Vectorised word scanning over Arrow string columns.

Texts stay in their Arrow buffer: a byte class table finds the words, a keyed
polynomial hash (64 bits, one table entry per byte) names them. Work goes in
slices of a bounded number of bytes, cut between documents, so that memory
follows the slice and not the batch; one very long document is its own slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240131))
BYTE_KEY = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
SEGMENT = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words of letters, digits and non-ASCII bytes, after lower-casing
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
#: words between ASCII white space
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SEGMENT + 1)
        b, v = np.full(size, BASE, np.uint64), np.full(size, BASE_INV, np.uint64)
        b[0] = v[0] = 1
        _pow, _inv = np.multiply.accumulate(b), np.multiply.accumulate(v)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice of documents: buf holds the lower-cased bytes, off the documents' ends."""

    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def first(self) -> np.ndarray:
        """Index of each document's first word, with the total at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.off))).astype(np.int64)


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets from 0; a null takes no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(off):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most max_bytes of text, or one row."""
    _, off = arrow_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, equal for equal words."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        origin = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, origin + SEGMENT, "right")))
        n = int(end[to - 1]) - origin
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_KEY[buf[origin : origin + n]] * power[:n], out=total[1:])
        s, e = start[at:to] - origin, end[at:to] - origin
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def scan(col: pa.Array, kind: np.ndarray, hashes: bool = True) -> Words:
    """The words of a string column whose bytes are all of the kind."""
    raw, off = arrow_bytes(col)
    buf = LOWER[raw]
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[buf]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(off[1:], start, "right")
    return Words(buf, off, start, end, doc, word_hashes(buf, start, end) if hashes else np.empty(0, np.uint64))
