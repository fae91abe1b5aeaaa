"""An FM-index over word codes: suffix order, wavelet matrix, sampled positions.

The indexed text is a sequence of runs of codes >= 1, each ended by its own
terminator. Terminators sort by position, below all codes, so suffixes are
compared within their run only and the order is total.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Access and rank over a sequence of small integers, a bit vector a level."""

    def __init__(self, codes: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = ((codes >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            self.zeros.append(len(codes) - int(np.count_nonzero(bit)))
            codes = np.concatenate([codes[~bit], codes[bit]])

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often code[j] stands before position i[j]."""
        low, i = np.zeros_like(i), i.copy()
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            one = ((code >> shift) & 1).astype(bool)
            l1, i1 = bits.rank1(low), bits.rank1(i)
            low = np.where(one, zeros + l1, low - l1)
            i = np.where(one, zeros + i1, i - i1)
        return i - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at each position and how often it stands before it."""
        code, low, i = np.zeros_like(i), np.zeros_like(i), i.copy()
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            one = bits.get(i).astype(bool)
            code |= one.astype(np.int64) << shift
            l1, i1 = bits.rank1(low), bits.rank1(i)
            low = np.where(one, zeros + l1, low - l1)
            i = np.where(one, zeros + i1, i - i1)
        return code, i - low


def suffix_order(text: np.ndarray, top: int) -> np.ndarray:
    """Positions of text in suffix order; zeros are terminators, ordered by position."""
    n = len(text)
    bits = int(top).bit_length()
    width = max(1, min(4, 62 // bits))
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    for j in range(width):
        digit = padded[j : j + n]
        ended |= digit == 0
        key = (key << bits) | np.where(ended, 0, digit)
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_end = key[order], ended[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | sorted_end[1:]
    reach = width
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = head
    single = fresh.copy()
    single[:-1] &= fresh[1:]
    open_ = np.flatnonzero(~single)
    while len(open_):
        at = order[open_]
        group = rank[at]
        then = rank[np.minimum(at + reach, n)]
        by = np.lexsort((then, group))
        at, group, then = at[by], group[by], then[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[at] = open_[head]
        single = new.copy()
        single[:-1] &= new[1:]
        open_ = open_[~single]
        reach *= 2
    return order


class FMIndex:
    """Backward search and locating over codes 1..top; every run ends with a zero."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        self.n = len(text)
        order = suffix_order(text, top)
        bwt = text[order - 1].astype(np.int64)  # at position 0 the last terminator
        self.tree = WaveletMatrix(bwt, top)
        self.below = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1)[: top + 1], out=self.below[1:])
        # a suffix that opens a run is always sampled: walking never crosses a terminator
        kept = (order % sample == 0) | (bwt == 0)
        self.marked, self.samples = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the patterns, rows of a matrix that end at column -1 (right-aligned)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            code = patterns[live, width - 1 - k].astype(np.int64)
            both = self.tree.rank(np.concatenate([code, code]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.below[code] + both[: len(live)]
            hi[live] = self.below[code] + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walked back to the nearest sample."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            done = self.marked.get(here).astype(bool)
            out[todo[done]] = self.samples[self.marked.rank1(here[done])] + steps
            todo, here = todo[~done], here[~done]
            if len(todo):
                code, before = self.tree.access_rank(here)
                at[todo] = self.below[code] + before
            steps += 1
        return out
