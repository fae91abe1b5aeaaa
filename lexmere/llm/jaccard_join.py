"""N-gram Jaccard join: exact links between shingle sets, and their components.

1. Each document's set of word shingles is hashed (64 bits); equal sets are one class.
   A set can only link if the required share of its shingles is in other sets too.
   Shingles go, as 32-bit prints, to ranges; a range counts for each document how
   many of its prints another one has. Documents with too few are done. (A chance
   meeting of prints only keeps a document that the next steps then tell apart.)
2. Which of the others can meet: two linked sets of at most r shingles differ in at most
   k = 2r(1-t)/(1+t) of them. The hash range is cut in more than k + 1 parts, so
   some g parts agree exactly; a part's signature is a key. A set leaves out its
   g - 1 weakest parts, those of fewest shingles, by an order of the signatures alone:
   the strongest part that two linked sets agree in is left out by neither. Sets
   meet only in keys, and a key's sets are tied to one of them, so a group of m sets
   gives m - 1 pairs. A set with g empty parts or more adds their keys, too, and
   leaves out none. Keys travel sorted and packed, one row for a task and a range of keys.
3. The ties' connected components bound the join: linked sets share one. They
   are dealt into blocks of bounded size. A component above the bound is cut in
   pieces that are joined each by itself; then all that is not in the largest part
   found meets the others and all of that part. A group of copies is one part after
   the first pass, so its sets are sent once.
4. Each component of a block is joined by T-occurrence search: sets come by size, a
   number of a set's longest inverted lists, chosen by DivideSkip's rule, is put
   aside, the rest is heap-merged with skips (very many entries in an array of counts),
   and what occurs there often enough is probed in the long lists by binary search. Sets of one part are not compared
   again: the link would add nothing.

Defined results: null, empty and white-space texts have an empty set, link with
nothing and are their own component. Repeated rows link with each other. A null
doc_id stays null, and takes its component's id where it has company. Only the
two named columns are read.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .carry import named
from .components import components
from .textscan import NON_SPACE, mix, scan, slices

SLICE_BYTES = 2 << 20
#: shingles in a block of small components, and the size of one piece of an oversized component
BLOCK_SHINGLES = 120_000
PIECE_SHINGLES = 250_000
PIECE_MEMBERS = 1_024
#: sets of each of the two pieces that meet afterwards: larger, as a set is sent to all pieces but its own
HALF_SHINGLES = 2_000_000
HALF_MEMBERS = 10_240
#: how much less a longer list counts when DivideSkip chooses how many to put aside
SKIP_WEIGHT = 0.01
#: the same where lists are merged in an array: above so many entries, so many candidates probed at a time
HEAP_ENTRIES, COUNT_WEIGHT, PROBED = 2_000, 1.0, 256
#: keys that a task holds before it sends them
HELD_KEYS = 1_000_000
#: prints that a task holds before it sends them, so that a range gets few and large messages
HELD_PRINTS = 3_000_000
#: lists of documents to read again are broadcast up to so many rows, and places in blocks up to so many
BROADCAST_ROWS = 1_000_000

U = np.uint64
STEP = U(0xD6E8FEB86659FD93)
SALT_A, SALT_B, SALT_P = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)


def shingle_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = scan(col, NON_SPACE)
    first = words.first()
    h, n = words.hash, len(words.hash)
    joined = h.copy()
    factor = U(1)
    with np.errstate(over="ignore"):
        for k in range(1, width):
            factor = factor * STEP
            joined[: max(0, n - k)] += h[k:] * factor
        joined = mix(joined)
        out = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                out.append(np.unique(joined[a : b - width + 1]))
            elif b > a:
                powers = np.array([pow(int(STEP), k, 2**64) for k in range(b - a)], U)
                out.append(mix(np.array([(h[a:b] * powers).sum() + U(b - a)], U) ^ SALT_P))
            else:
                out.append(np.empty(0, U))
    return out


class Levels:
    """Size levels: each reaches 1/t times as far as the one before; parts and differences allowed in each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.top = [1]

    def at(self, i: int) -> int:
        while len(self.top) <= i:
            self.top.append(-(-self.top[-1] * 100 // self.percent) if self.percent < 100 else self.top[-1] + 1)
        return self.top[i]

    def of(self, n: int) -> int:
        i = 0
        while self.at(i) < n:
            i += 1
        return i

    def shape(self, i: int) -> tuple[int, int]:
        """(differences, parts) of a level."""
        k = 2 * (100 - self.percent) * self.at(i) // (100 + self.percent)
        return k, k + 1 + -(-(k + 1) // 4)

    def agreed(self, n: int, i: int) -> int:
        """In how many parts of level i a set of n shingles agrees with any that it links with there, at least."""
        k, parts = self.shape(i)
        most = min(self.at(i), 100 * n // self.percent)  # the size of such a set
        return parts - min(k, (100 - self.percent) * (n + most) // (100 + self.percent))


def signatures(own: np.ndarray, weight: np.ndarray, levels: Levels, known: dict[int, int]) -> list[np.ndarray]:
    """The keys of a set in its own level and, if a set there can link with it, the next."""
    n = len(own)
    if n not in known:
        known[n] = levels.of(n)
    out = []
    for i in (known[n], known[n] + 1):
        k, parts = levels.shape(i)
        if not k or (i > known[n] and 100 * n // levels.percent <= levels.at(known[n])):
            continue
        part = ((own >> U(32)) * U(parts)) >> U(32)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        name = (U(i) << U(40)) | part[begin]
        key = mix(np.add.reduceat(weight, begin) ^ mix(name ^ SALT_P))
        weak = levels.agreed(n, i) - 1 - (parts - len(begin))
        if weak < 0:
            none = np.setdiff1d(np.arange(parts, dtype=U), part[begin])
            out += [key, mix(mix(((U(i) << U(40)) | none) ^ SALT_P))]
        else:
            out.append(key[np.lexsort((key, np.diff(begin, append=n)))[weak:]])
    return out


def set_hashes(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a, b = mix(own ^ SALT_A).sum(dtype=U), mix(own ^ SALT_B).sum(dtype=U)
    h = mix(np.array([a, b], U) + U(len(own))).view(np.int64)
    return int(h[0]), int(h[1])


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))


HEADS = "chunk long, range int, prints binary, heads binary"
PLAIN = "doc_id long, n long, one long, two long, text_hash long, eligible boolean"
KEYS = "range int, blob binary, a long, b long"


def _sparse(at: np.ndarray, count: np.ndarray) -> bytes:
    """Rising places and a count at each, in as few bytes as their size allows."""
    parts, head = [np.diff(at, prepend=0), count], [len(at)]
    for k, x in enumerate(parts):
        kind = next(w for w in (1, 2, 4, 8) if x.max(initial=0) < 1 << 8 * w)
        parts[k] = x.astype(f"<u{kind}")
        head.append(kind)
    return np.array(head, "<u4").tobytes() + b"".join(x.tobytes() for x in parts)


def _dense(blob) -> tuple[np.ndarray, np.ndarray, int]:
    """The places and counts of _sparse, and where they end."""
    n, a, b = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    gap, count = np.frombuffer(blob, f"<u{a}", n, 12), np.frombuffer(blob, f"<u{b}", n, 12 + n * a)
    return np.cumsum(gap, dtype=np.int64), count.astype(np.int64), 12 + n * (a + b)


def _documents(own: DataFrame, width: int, percent: int, ranges: int) -> DataFrame:
    """PLAIN: every document with its set's size and hashes, and whether enough of it is in other sets.

    A chunk sends a range its prints and, of the documents that have some there, the
    numbers; a range sends back the numbers met elsewhere, where there are any. So
    what travels grows with the prints, however many ranges there are. What a chunk knows of
    its documents (heads) goes by way of one range, another for each chunk.
    """

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        heads: list[np.ndarray] = []

        def sent_on() -> pa.RecordBatch:
            nonlocal at
            chunk, head = (part << 32) + at, np.concatenate(heads)
            flat = np.concatenate([*held, np.empty(0, U)])
            of = np.repeat(np.arange(len(head)), head[:, 2])
            to = ((flat >> U(32)) * U(ranges)) >> U(32)
            with np.errstate(over="ignore"):
                print_ = (mix(flat) >> U(32)).astype("<u4")
                home = int(mix(np.array([chunk], U))[0] % U(ranges))
            by = np.argsort(to, kind="stable")
            used, cut = np.unique(to[by], return_index=True)
            rows = {int(r): by[x:y] for r, x, y in zip(used, cut, [*cut[1:], len(by)])}
            rows.setdefault(home, by[:0])
            blobs = []
            for own_rows in rows.values():
                docs, count = np.unique(of[own_rows], return_counts=True)
                blobs.append(_sparse(docs, count) + print_[own_rows].tobytes())
            held.clear()
            heads.clear()
            at += 1
            known = head.astype("<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), chunk, np.int64)), pa.array(list(rows), pa.int32()), pa.array(blobs, pa.binary()), pa.array([known if r == home else None for r in rows], pa.binary())], names=["chunk", "range", "prints", "heads"])

        for batch in batches:
            for slice_ in slices(batch, "text", SLICE_BYTES):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(slice_.column(1), width)
                    hashes = [set_hashes(x) for x in sets]
                n = np.array([len(x) for x in sets], np.int64)
                present = np.asarray(slice_.column(0).is_valid())
                name = np.asarray(slice_.column(0).fill_null(0))
                heads.append(np.concatenate([np.stack([name, present, n, np.asarray(slice_.column(2))], 1), np.array(hashes, np.int64).reshape(-1, 2)], 1))
                held += sets
                if sum(int(x[:, 2].sum()) for x in heads) > HELD_PRINTS:
                    yield sent_on()
        if heads:
            yield sent_on()

    def counted(table: pa.Table) -> pa.Table:
        parts = []
        for x in table["prints"].combine_chunks():
            raw = x.as_buffer()
            docs, count, end = _dense(raw)
            parts.append((docs, count, np.frombuffer(raw, "<u4", offset=end)))
        every = np.sort(np.concatenate([p for _, _, p in parts]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for docs, count, prints in parts:
            near = np.minimum(np.searchsorted(twice, prints), max(0, len(twice) - 1))
            hit = twice[near] == prints if len(twice) else np.zeros(len(prints), bool)
            met = np.bincount(np.repeat(np.arange(len(count)), count)[hit], minlength=len(count))
            out.append(_sparse(docs[met > 0], met[met > 0]) if met.any() else None)
        return pa.table({"chunk": table["chunk"], "shared": pa.array(out, pa.binary()), "heads": table["heads"]}).filter(pa.array([x is not None or y.is_valid for x, y in zip(out, table["heads"])], pa.bool_()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shared, heads in zip(batch.column(0), batch.column(1)):
                head = np.frombuffer(heads.as_buffer(), "<i8").reshape(-1, 6)
                found = np.zeros(len(head), np.int64)
                for x in shared.values:
                    docs, count, _ = _dense(x.as_buffer())
                    found[docs] += count
                n = head[:, 2]
                fits = (n > 0) & (100 * found >= percent * n)
                yield pa.RecordBatch.from_arrays([pa.array(head[:, 0], mask=head[:, 1] == 0), pa.array(n), pa.array(head[:, 4]), pa.array(head[:, 5]), pa.array(head[:, 3]), pa.array(fits)], names=[x.split()[0] for x in PLAIN.split(", ")])

    sent = own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(printed, HEADS)
    back = sent.groupBy("range").applyInArrow(counted, "chunk long, shared binary, heads binary")
    whole = back.groupBy("chunk").agg(F.collect_list("shared").alias("shared"), F.max("heads").alias("heads"))
    return scratch.table(whole.select("shared", "heads").mapInArrow(rows, PLAIN), "documents")


def _row(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of KEYS, null where no column is given."""
    kinds = {"range": pa.int32(), "blob": pa.binary()}
    names = [x.split()[0] for x in KEYS.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(rows, kinds.get(x, pa.int64()))) for x in names], names=names)


def _pack_keys(key: np.ndarray, one: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of 48 bits where they fit, and the set of each by number."""
    sets, at = np.unique(one, return_inverse=True)
    gap = np.diff(key, prepend=U(0))
    gap[0] = 0
    small = U(gap.max()) < U(1 << 48)
    parts = [gap.astype("<u4"), (gap >> U(32)).astype("<u2")] if small else [gap.astype("<u8")]
    head = np.array([len(key), len(sets), small], "<u8")
    wide = "<u2" if len(sets) < 1 << 16 else "<u4"
    return b"".join(x.tobytes() for x in (head, key[:1].astype("<u8"), *parts, at.astype(wide), sets.astype("<i8")))


def _unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, small = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    at = 32
    start = np.frombuffer(blob, "<u8", 1, 24)

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, k, at)
        at += out.nbytes
        return out

    gap = take("<u4", n).astype(U) | (take("<u2", n).astype(U) << U(32)) if small else take("<u8", n)
    which = take("<u2" if m < 1 << 16 else "<u4", n)
    return start + np.cumsum(gap, dtype=U), take("<i8", m)[which]


def _ties(key: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys and a set of each, and pairs that tie a key's other sets to it."""
    by = np.lexsort((one, key))
    key, one = key[by], one[by]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    centre = one[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    apart = centre != one
    return key[first], one[first], *_forest(centre[apart], one[apart])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the given ones do: each node with the least of its component."""
    names, at = np.unique(np.stack([a, b], 1), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in np.unique(at.reshape(-1, 2), axis=0).tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    least = np.array([root(x) for x in range(len(names))], np.int64)
    apart = least != np.arange(len(names))
    return names[least[apart]], names[apart]


def _keys(own: DataFrame, width: int, percent: int, ranges: int) -> DataFrame:
    """Rows of two kinds: keys of a range, packed; a pair of sets.

    Sets of one task that share a key are paired at once and send the key once,
    so a range receives a key at most as often as there are tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, known = Levels(percent), {}
        keys: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key, one, a, b = _ties(np.concatenate(keys), np.concatenate(sets))
            keys.clear()
            sets.clear()
            if len(a):
                yield _row(len(a), a=pa.array(a), b=pa.array(b))
            to = ((key >> U(32)) * U(ranges)) >> U(32)
            cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
            for x, y in zip(cut[:-1], cut[1:]):
                yield _row(1, range=pa.array([int(to[x])], pa.int32()), blob=pa.array([_pack_keys(key[x:y], one[x:y])], pa.binary()))

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                with np.errstate(over="ignore"):
                    for own_set in shingle_sets(part.column(1), width):
                        name = set_hashes(own_set)[0] if len(own_set) else 0
                        for x in signatures(own_set, mix(own_set ^ SALT_B), levels, known) if len(own_set) else ():
                            keys.append(x)
                            sets.append(np.full(len(x), name, np.int64))
                            held += len(x)
                    if held > HELD_KEYS:
                        yield from flush()
                        held = 0
        with np.errstate(over="ignore"):
            yield from flush()

    return own.mapInArrow(run, KEYS)


def _tied(table: pa.Table) -> pa.Table:
    """The pairs of a range's keys."""
    found = [_unpack_keys(x.as_buffer()) for x in table["blob"].combine_chunks()]
    _, _, a, b = _ties(np.concatenate([k for k, _ in found]), np.concatenate([o for _, o in found]))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _packed(own: np.ndarray) -> bytes:
    """A sorted set as its gaps: their highest bytes, which are nearly all alike, stand apart from the others and compress well."""
    gaps = np.diff(own, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return gaps[:, 7].tobytes() + gaps[:, :7].tobytes()


def _unpacked(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    n = len(raw) // 8
    gaps = np.empty((n, 8), np.uint8)
    gaps[:, 7], gaps[:, :7] = raw[:n], raw[n:].reshape(n, 7)
    return np.cumsum(gaps.view("<u8").reshape(-1), dtype=U)


class Block:
    """T-occurrence join of sets; join() gives the component of each.

    label: what is known to belong together; side: sets of equal side are not compared
    (their pairs are another block's). Lists hold sets by size, so the sizes that can
    link with a set are one stretch of every list.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, side: np.ndarray | None = None):
        self.percent = percent
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        n = len(self.order)
        self.size = np.array([len(sets[i]) for i in self.order], np.int64)
        flat = np.concatenate([sets[i] for i in self.order]) if n else np.empty(0, U)
        owner = np.repeat(np.arange(n), self.size)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1  # a shingle of one set alone is in no overlap
        keep = shared[code]
        self.code, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
        self.first = np.searchsorted(owner, np.arange(n + 1))
        by = np.argsort(self.code, kind="stable")
        self.post_owner = owner[by]
        self.pairs = self.code[by] * n + self.post_owner  # sorted: every list can be probed at once
        self.label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].reshape(-1)[self.order]
        self.side = None if side is None else side[self.order]
        self.recent = -1
        self.members: dict[int, list[int]] = {}
        for i, x in enumerate(self.label.tolist()):
            self.members.setdefault(x, []).append(i)

    def _unite(self, x: int, y: int) -> None:
        a, b = int(self.label[x]), int(self.label[y])
        if len(self.members[a]) > len(self.members[b]):
            a, b = b, a
        self.label[self.members[a]] = b
        self.members[b] += self.members.pop(a)

    def _linked(self, x: int, y: int, found: int, long: np.ndarray) -> bool:
        """Whether y, found so often in the short lists, links with x: the long lists are probed by binary search."""
        wanted = long + y
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        overlap = found + int((self.pairs[at] == wanted).sum())
        return 100 * overlap >= self.percent * int(self.size[x] + self.size[y] - overlap)

    def _open(self, flat: np.ndarray, bound: np.ndarray, x: int, beyond: int) -> list[list[int]]:
        """The lists without sets up to `beyond`, of x's own component or of its side."""
        keep = (self.label[flat] != self.label[x]) & (flat > beyond)
        if self.side is not None:
            keep &= self.side[flat] != self.side[x]
        ends = np.concatenate([[0], np.cumsum(keep)])[bound].tolist()
        left = flat[keep].tolist()
        return [left[a:b] for a, b in zip(ends[:-1], ends[1:]) if b > a]

    def _search(self, x: int, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: int) -> None:
        """Unites x with what links with it.

        The `aside` longest lists are only probed, the others merged. Few entries are
        merged by a heap that skips: where fewer than `least` lists stand at the smallest
        set, so many are moved on, by binary search, to the first set that can still occur
        so often. Many are merged in an array of counts; an entry is cheap there, so fewer
        lists are put aside.
        """
        n, low = len(self.order), int(self.post_owner[lo].min())
        # among copies the set that linked last mostly links again, which leaves nothing of its component to merge
        if low <= self.recent < x and self.label[self.recent] != self.label[x] and (self.side is None or self.side[self.recent] != self.side[x]):
            if self._linked(x, self.recent, 0, codes * n):
                self._unite(x, self.recent)
        by = np.argsort(hi - lo, kind="stable")
        codes, lo, hi = codes[by], lo[by], hi[by]
        by_heap = int((hi - lo).sum()) <= HEAP_ENTRIES
        weight = SKIP_WEIGHT if by_heap else COUNT_WEIGHT
        aside = min(need - 1, int(need / (weight * math.log2(int(hi[-1] - lo[-1]) + 1) + 1)))
        short, least = len(codes) - aside, need - aside
        long = codes[short:] * n
        flat = np.concatenate([self.post_owner[a:b] for a, b in zip(lo[:short], hi[:short])])
        if not by_heap:
            self._count(x, flat, long, aside)
            return
        bound = np.concatenate([[0], np.cumsum((hi - lo)[:short])])
        beyond = -1
        while True:
            queues = self._open(flat, bound, x, beyond)
            heap = [(q[0], k) for k, q in enumerate(queues)]
            heapq.heapify(heap)
            place, united = [0] * len(queues), False
            while len(heap) >= least:
                y, popped = heap[0][0], []
                while heap and heap[0][0] == y:
                    popped.append(heapq.heappop(heap)[1])
                if len(popped) >= least:
                    if self._linked(x, y, len(popped), long):
                        self._unite(x, y)
                        beyond, united, self.recent = y, True, y
                        break
                    goal = y + 1
                else:
                    while heap and len(popped) < least - 1:
                        popped.append(heapq.heappop(heap)[1])
                    if not heap:
                        break
                    goal = heap[0][0]
                for k in popped:
                    at = bisect.bisect_left(queues[k], goal, place[k])
                    if at < len(queues[k]):
                        place[k] = at
                        heapq.heappush(heap, (queues[k][at], k))
            if not united:
                return

    def _count(self, x: int, flat: np.ndarray, long: np.ndarray, aside: int) -> None:
        """The merge of many entries: sets that occur often enough are probed in the long lists, some at a time."""
        counts = np.bincount(flat, minlength=len(self.order))
        needed = -(-self.percent * (self.size[x] + self.size) // (100 + self.percent))
        near = np.flatnonzero((counts > 0) & (counts + aside >= needed))
        if self.side is not None:
            near = near[self.side[near] != self.side[x]]
        while len(near := near[self.label[near] != self.label[x]]):
            own, near = near[:PROBED], near[PROBED:]
            wanted = long[:, None] + own
            at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            overlap = counts[own] + (self.pairs[at] == wanted).sum(0)
            for y in own[overlap >= needed[own]].tolist():
                if self.label[y] != self.label[x]:
                    self._unite(x, y)
                    self.recent = y

    def join(self) -> np.ndarray:
        """The component of each set, in the order given."""
        n = len(self.order)
        for x in range(1, n):
            codes = self.code[self.first[x] : self.first[x + 1]]
            need = -(-self.percent * int(self.size[x]) // 100)  # of x and any smaller or equal set
            if len(codes) < need:
                continue
            low = int(np.searchsorted(100 * self.size, self.percent * self.size[x]))
            lo, hi = np.searchsorted(self.pairs, codes * n + low), np.searchsorted(self.pairs, codes * n + x)
            some = hi > lo
            if some.sum() >= need:
                self._search(x, codes[some], lo[some], hi[some], need)
        out = np.empty(n, np.int64)
        out[self.order] = self.label
        return out


def _join_block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node, root, label = (table[c].to_numpy() for c in ("node", "root", "label"))
        side = np.array(table["side"].to_pylist(), object)
        sets = [_unpacked(x.as_buffer()) for x in table["shingles"].combine_chunks()]
        pairs: set[tuple[int, int]] = set()
        by = np.lexsort((node, root))
        for own in np.split(by, np.flatnonzero(np.diff(root[by])) + 1):
            own = own[np.unique(node[own], return_index=True)[1]]  # a repeated row brings its set once
            apart = None if side[own[0]] is None else side[own].astype(np.int64)
            found = Block([sets[k] for k in own], percent, label[own], apart).join()
            low: dict[int, int] = {}
            for name, group in zip(label[own].tolist(), found.tolist()):
                low[group] = min(name, low.get(group, name))
            pairs.update((name, low[group]) for name, group in zip(label[own].tolist(), found.tolist()) if low[group] != name)
        a, b = zip(*sorted(pairs)) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _found(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, text_hash, and group, which names its component whatever ids it holds; null without a set."""
    own = _own(docs, id_col, text_col)
    ranges = max(8, own.rdd.getNumPartitions())
    plain = _documents(own, width, percent, ranges)
    classes = scratch.table(plain.where("eligible AND doc_id IS NOT NULL").groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    if classes.count() <= BROADCAST_ROWS:
        reps = F.broadcast(reps)
    both = scratch.table(_keys(own.join(reps, "doc_id", "left_semi"), width, percent, ranges), "keys")
    met = both.where("range IS NOT NULL").select("range", "blob").groupBy("range").applyInArrow(_tied, "a long, b long")
    edges = both.where("a IS NOT NULL").select("a", "b").unionByName(met)
    coarse = scratch.table(components(edges), "coarse")
    roots = _roots(own, classes, coarse, width, percent)
    grouped = scratch.table(classes.join(roots.withColumnRenamed("node", "one"), "one", "left").select("one", "two", "n", "rep", F.coalesce("root", "one").alias("group")), "grouped")
    least = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    of_class = grouped.drop("rep").join(F.broadcast(least) if classes.count() <= BROADCAST_ROWS else least, "group")
    some = plain.where("n > 0").join(of_class, ["one", "two", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", F.coalesce("group", "one").alias("group"))
    none = plain.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("group"))
    return some.unionByName(none)


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    return _found(docs, width, percent, id_col, text_col).drop("text_hash", "group")


def _roots(own: DataFrame, classes: DataFrame, coarse: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of the sets, by hash, that are linked with another; root is the same for all of a component."""
    met = scratch.table(classes.join(coarse.withColumnRenamed("node", "one"), "one").select("rep", "one", "two", "n", "root"), "met")
    sizes = met.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    pieces = F.greatest(F.ceil(F.col("members") / PIECE_MEMBERS), F.ceil(F.col("shingles") / PIECE_SHINGLES)).cast("long")
    large = scratch.table(sizes.where((F.col("members") > PIECE_MEMBERS) | (F.col("shingles") > PIECE_SHINGLES)).select("root", pieces.alias("pieces")), "large")
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // BLOCK_SHINGLES))
    piece = F.pmod(F.xxhash64("one"), F.col("pieces"))
    block = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("root"), F.lit(blocks)).cast("string")).otherwise(F.concat_ws(":", "root", piece))
    apart = F.lit(None).cast("int")
    dealt = met.join(large, "root", "left").select("rep", "one", "two", "root", F.col("one").alias("label"), F.array(F.struct(block.alias("block"), apart.alias("side"))).alias("blocks"))
    found = scratch.table(_joined(own, dealt, width, percent), "links")
    if not large.count():
        return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # pieces of one component know their own links now; what is not in a component's largest part meets all of it
    inner = scratch.table(components(found), "inner")
    labelled = met.join(large, "root").join(inner.select(F.col("node").alias("one"), F.col("root").alias("label")), "one", "left").withColumn("label", F.coalesce("label", "one"))
    labelled = scratch.table(labelled, "labelled")
    parts = labelled.groupBy("root", "label").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    most = parts.groupBy("root").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.sum("k").alias("all"), F.max("k").alias("k"), F.sum("shingles").alias("s"), F.max_by("shingles", F.struct("k", "label")).alias("most_s"))
    cut = lambda members, shingles: F.greatest(F.ceil(members / HALF_MEMBERS), F.ceil(shingles / HALF_SHINGLES)).cast("long")
    plan = most.where(F.col("all") > F.col("k")).select("root", "most", cut(F.col("all") - F.col("k"), F.col("s") - F.col("most_s")).alias("others"), cut(F.col("k"), F.col("most_s")).alias("mains"))
    both = labelled.drop("pieces").join(plan, "root")
    other = F.col("label") != F.col("most")
    p, q = F.pmod(F.xxhash64("one"), F.col("mains")), F.pmod(F.xxhash64("one"), F.col("others"))
    to_mains = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda j: F.struct(F.concat_ws(":", "root", F.lit("m"), q, j).alias("block"), F.lit(0).alias("side")))
    same = F.struct(F.concat_ws(":", "root", F.lit("o"), q, q).alias("block"), apart.alias("side"))
    to_others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda j: j != q), lambda j: F.struct(F.concat_ws(":", "root", F.lit("o"), F.least(q, j), F.greatest(q, j)).alias("block"), (q > j).cast("int").alias("side")))
    to_all = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda i: F.struct(F.concat_ws(":", "root", F.lit("m"), i, p).alias("block"), F.lit(1).alias("side")))
    again = both.select("rep", "one", "two", "root", "label", F.when(other, F.concat(to_mains, F.array(same), to_others)).otherwise(to_all).alias("blocks"))
    return components(inner.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_joined(own, again, width, percent)))


def _joined(own: DataFrame, dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): labels that links connect. dealt: sets (rep, one, two) with their label and their blocks (block, side)."""
    dealt = scratch.table(dealt.withColumnRenamed("rep", "doc_id"), "dealt")
    # a set of a large component stands in many blocks, so places count and not rows
    few = dealt.agg(F.coalesce(F.sum(1 + F.size("blocks")), F.lit(0))).first()[0] <= BROADCAST_ROWS

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(part.column(0), width)
                    same = []
                    for k, (own_set, *name) in enumerate(zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist())):
                        if tuple(name) not in sent and set_hashes(own_set) == tuple(name):
                            sent.add(tuple(name))
                            same.append(k)
                kept = [part.column(k).take(pa.array(same, pa.int64())) for k in (1, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([kept[0], pa.array([_packed(sets[k]) for k in same], pa.binary()), *kept[1:]], names=["node", "shingles", "root", "label", "blocks"])

    again = own.join(F.broadcast(dealt) if few else dealt, "doc_id").select("text", "one", "two", "root", "label", "blocks")
    sets = again.mapInArrow(shingled, "node long, shingles binary, root long, label long, blocks array<struct<block:string,side:int>>")
    rows = sets.select("node", "shingles", "root", "label", F.explode("blocks").alias("x")).select("node", "shingles", "root", "label", "x.block", "x.side")
    return rows.groupBy("block").applyInArrow(_join_block(percent), "a long, b long")


def duplicates(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash) of all but the first document of each component, the first by both."""
    found = scratch.table(_found(docs, width, percent, id_col, text_col).where("doc_id IS NOT NULL AND group IS NOT NULL").select("doc_id", "component_id", "text_hash", "group"), "found")
    later = found.where("component_id < doc_id").select("doc_id", "text_hash")
    # an id that stands with several linked texts keeps one of them
    firsts = found.where("component_id = doc_id").select("doc_id", "group", "text_hash").distinct()
    several = firsts.groupBy("doc_id", "group").agg(F.min("text_hash").alias("least"), F.count("*").alias("k")).where("k > 1").select("doc_id", "group", "least")
    return later.unionByName(firsts.join(several, ["doc_id", "group"]).where("text_hash <> least").select("doc_id", "text_hash")).distinct()


def first_of_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the duplicates.

    A row goes by its id and its text, so a text of its own stays where another text of
    the same id goes. A row without an id stays; of rows that repeat an id and a text one stays.
    """
    gone = scratch.table(duplicates(docs, width, percent, id_col, text_col), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    name, text = (F.col(f"of_docs.{named(c)}") for c in (id_col, text_col))
    same = (name.cast("long") == F.col("of_gone.doc_id")) & (F.xxhash64(text.cast("string")) == F.col("of_gone.text_hash"))
    left = docs.alias("of_docs").join(gone.alias("of_gone"), same, "left_anti").select(*[F.col(f"of_docs.{named(c)}") for c in docs.columns])
    # only rows whose id and text's hash repeat are exchanged
    pair = (F.col(named(id_col)).alias("of_id"), F.xxhash64(F.col(named(text_col)).cast("string")).alias("of_text"))
    again = scratch.table(left.where(F.col(named(id_col)).isNotNull()).select(*pair).groupBy("of_id", "of_text").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    k = again.count()
    if not k:
        return left
    if k <= BROADCAST_ROWS:
        again = F.broadcast(again)
    match = (F.col(f"of_left.{named(id_col)}") == F.col("of_again.of_id")) & (F.xxhash64(F.col(f"of_left.{named(text_col)}").cast("string")) == F.col("of_again.of_text"))
    parts = [left.alias("of_left").join(again.alias("of_again"), match, how).select(*[F.col(f"of_left.{named(c)}") for c in docs.columns]) for how in ("left_anti", "left_semi")]
    return parts[0].unionByName(parts[1].dropDuplicates([id_col, text_col]))
