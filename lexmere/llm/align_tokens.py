"""Alignment of two tokenizers over the same bytes, and how often their ids are linked in the corpus.

A reads a text with a space before it, B adds that space itself, so the tokens of both are
intervals over the same bytes. Bytes at which tokens of both end cut them into groups; the
tokens of a group are linked.

1. Neither tokenizer joins anything across a single space before a visible character, and both
   end a token there, so a text falls into pieces that are aligned alone. Pieces recur: a task
   aligns each new one once and keeps it, within a bound.
2. DuckDB aligns the new pieces of a slice of documents from tables of token intervals: groups
   are the ends that both tables have, numbered by a window sum; an ASOF join finds the group of
   a B token, a range join checks that it lies within; ids of a group are counted before they are
   paired, so copies of a token in a group are not multiplied out. It also sums a document's pairs
   over its pieces.
3. Documents travel in chunks: a chunk sends its distinct pairs, with the documents of each, to
   ranges of pairs. A range adds them up and answers in the order asked, so a pair that is in
   every document is one entry a chunk. Highest counts of an A id are grouped in Spark; there are
   at most as many as ids, which is the bound of what is broadcast.
4. Chunks meet their answers, and each document adds up its links.

Defined results: texts that are null, empty, or whose bytes the tokenizers do not give back have
no tokens: all numbers are 0, the digest is ''. Repeated rows count as documents of their own. A
null doc_id stays null. Only the two named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .carry import named
from .textscan import slices

SLICE_BYTES = 4 << 20
#: a chunk is sent when its documents hold so many pairs
CHUNK_PAIRS = 6_000_000
#: pieces that a task remembers, and the longest that it does
PIECES, PIECE_CHARS = 400_000, 256
#: pieces encoded side by side
JOINED = 4096
#: requests of a range, at most about so many bytes
RANGE_BYTES = 32 << 20
#: ids of A and of B that a pair's number has room for
A_IDS, B_IDS = 1 << 16, 1 << 15
NAMES = [str(k) for k in range(A_IDS)]

# a single space before a character that is surely visible; doubtful ones only make pieces longer
CUT = re.compile("(?<=[^ ▁]) (?=[!-~¡-࿿⁰-⿿、-퟿豈-﷿])")
SIMPLE = re.compile("[^!-~¡-࿿ ]|  |^ | $")
# pieces that begin and end so that they can stand side by side
JOINABLE = re.compile("[!-~¡-࿿⁰-▀▂-⿿、-퟿豈-﷿][^▁]*(?<! )", re.DOTALL)
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

DOCS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, range int, keys binary, docs binary"
ANSWER = "chunk long, range int, counts binary, a int, most long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(text: str) -> list[str]:
    """The pieces of a text, without the space that stands before each."""
    return CUT.split(text) if SIMPLE.search(text) else text.split(" ")


def _byte_of_letter() -> dict[str, int]:
    """The byte of each printable stand-in of byte-level vocabularies: printable bytes are their own, the rest count up from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte, special = _byte_of_letter(), {k: v.content.encode() for k, v in self.a.get_added_tokens_decoder().items()}
        names = [self.a.id_to_token(k) for k in range(self.a.get_vocab_size())]
        self.a_bytes = [special[k] if k in special else bytes([byte[c] for c in x]) for k, x in enumerate(names)]
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            x = self.b.id_to_piece(k)
            found = BYTE_PIECE.fullmatch(x)
            self.b_bytes.append(bytes([int(found[1], 16)]) if found else x.replace("▁", " ").encode())
        if len(self.a_bytes) > A_IDS or len(self.b_bytes) > B_IDS:
            raise ValueError("a vocabulary has more ids than a pair's number has room for")
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))

    def encode(self, pieces: list[str]) -> tuple[list, list]:
        """The ids of A and of B of each piece; none where a tokenizer does not give the bytes back."""
        a, b = [()] * len(pieces), [()] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if JOINABLE.fullmatch(p)]
        alone = sorted(set(range(len(pieces))).difference(plain))
        for x in range(0, len(plain), JOINED):
            own = plain[x : x + JOINED]
            # pieces side by side are cut where the text of one ends
            text = " ".join([pieces[k] for k in own])
            raw = b" " + text.encode()
            ends = np.cumsum([1 + len(pieces[k].encode()) for k in own])
            found = []
            for ids, names, length in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes, self.a_len), (self.b.encode(text), self.b_bytes, self.b_len)):
                if b"".join(map(names.__getitem__, ids)) == raw:
                    at = np.searchsorted(np.cumsum(length[ids]), ends, "right").tolist()
                    found.append([ids[i:j] for i, j in zip([0, *at], at)])
            if len(found) < 2:
                alone += own
                continue
            for k, i, j in zip(own, *found):
                a[k], b[k] = i, j
        for k in alone:
            i, j = self.a.encode(" " + pieces[k], add_special_tokens=False).ids, self.b.encode(pieces[k])
            raw = b" " + pieces[k].encode()
            if b"".join(map(self.a_bytes.__getitem__, i)) == raw and b"".join(map(self.b_bytes.__getitem__, j)) == raw:
                a[k], b[k] = i, j
        return a, b


#: tables of tokens: piece, number, id, first byte and the byte after the last
ALIGNED = """
    CREATE OR REPLACE TEMP TABLE groups AS
    SELECT piece, coalesce(lag(e) OVER w, 0) AS s, e, CAST(sum(1) OVER w AS INTEGER) - 1 AS g
    FROM (SELECT a.piece, a.e FROM a_tokens a JOIN b_tokens b ON a.piece = b.piece AND a.e = b.e)
    WINDOW w AS (PARTITION BY piece ORDER BY e);
    CREATE OR REPLACE TEMP TABLE a_in AS
    SELECT piece, i, id, CAST(coalesce(sum(ends) OVER (PARTITION BY piece ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS g
    FROM (SELECT a.*, CAST(groups.e IS NOT NULL AS INTEGER) AS ends FROM a_tokens a LEFT JOIN groups ON groups.piece = a.piece AND groups.e = a.e);
    CREATE OR REPLACE TEMP TABLE b_in AS
    SELECT b.piece, b.i, b.id, groups.g FROM b_tokens b ASOF JOIN groups ON b.piece = groups.piece AND b.s >= groups.s WHERE b.e <= groups.e;
"""
PAIRS = """
    INSERT INTO pairs SELECT piece, CAST(a * 32768 + b AS INTEGER) AS pair, sum(k * m) AS times
    FROM (SELECT piece, g, id AS a, count(*) AS k FROM a_in GROUP BY ALL) JOIN (SELECT piece, g, id AS b, count(*) AS m FROM b_in GROUP BY ALL) USING (piece, g) GROUP BY ALL
"""
OF_DOCS = "SELECT doc, pair, CAST(sum(k * times) AS BIGINT) AS times FROM (SELECT doc, piece, count(*) AS k FROM occurrences GROUP BY ALL) JOIN pairs USING (piece) GROUP BY ALL ORDER BY doc, pair"


def _intervals(ids: list, first: int, length: np.ndarray) -> pa.Table:
    """The tokens of pieces numbered from `first` on."""
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    end = np.cumsum(length[flat])
    before = np.concatenate([[0], end])[begin]
    end = end - before[of]
    return pa.table({"piece": pa.array((of + first).astype(np.int32)), "i": pa.array((np.arange(len(flat)) - begin[of]).astype(np.int32)), "id": pa.array(flat.astype(np.int32)), "s": pa.array(end - length[flat]), "e": pa.array(end)})


def _digests(a: dict[str, np.ndarray], b: dict[str, np.ndarray], first: int, n: int) -> tuple[list[int], list[str]]:
    """Groups of each piece, and its groups as text: ids of A, |, ids of B, and ; between groups."""
    piece = np.concatenate([a["piece"], b["piece"]]).astype(np.int64) - first
    ids, g = np.concatenate([a["id"], b["id"]]), np.concatenate([a["g"], b["g"]]).astype(np.int64)
    side = np.repeat([0, 1], [len(a["id"]), len(b["id"])])
    # both tables are in this order already, so a stable sort merges them, and tokens of a side stay in order
    by = np.argsort((piece * (int(g.max(initial=0)) + 1) + g) * 2 + side, kind="stable")
    piece, ids, g, side = piece[by], list(map(NAMES.__getitem__, ids[by].tolist())), g[by], side[by]
    groups = np.zeros(n, np.int64)
    np.maximum.at(groups, piece, g + 1)
    same_group = (piece[1:] == piece[:-1]) & (g[1:] == g[:-1])
    sign = np.where(same_group & (side[1:] == side[:-1]), ",", np.where(same_group, "|", ";")).tolist()
    parts = list(chain.from_iterable(zip(ids, [*sign, ""])))
    ends = (2 * np.searchsorted(piece, np.arange(n + 1))).tolist()
    return groups.tolist(), ["".join(parts[x : max(x, y - 1)]) for x, y in zip(ends[:-1], ends[1:])]


class Aligner:
    """Pieces, aligned when they are first met: number, tokens of A and of B, groups, digest."""

    def __init__(self, tokens: Tokens):
        import duckdb

        self.tokens = tokens
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self.known: dict[str, tuple[int, int, int, int, str]] = {}
        self.again: set[str] = set()
        self.next = 0
        self.db.execute("CREATE TEMP TABLE pairs (piece INTEGER, pair INTEGER, times BIGINT)")

    def _forget(self) -> None:
        """Keeps the pieces that have come again, all of them short, if they are no more than half of what is held."""
        kept = {p: self.known[p] for p in self.again if p in self.known and len(p) <= PIECE_CHARS}
        self.known = kept if 2 * len(kept) <= PIECES else {}
        self.again.clear()
        renumbered = pa.table({"piece": pa.array([x[0] for x in self.known.values()], pa.int32()), "now": pa.array(range(len(self.known)), pa.int32())})
        self.db.register("kept", renumbered)
        self.db.execute("CREATE OR REPLACE TEMP TABLE pairs AS SELECT now AS piece, pair, times FROM pairs JOIN kept USING (piece)")
        self.db.unregister("kept")
        self.known = {p: (k, *x[1:]) for k, (p, x) in enumerate(self.known.items())}
        self.next = len(self.known)

    def _add(self, pieces: list[str]) -> None:
        first, self.next = self.next, self.next + len(pieces)
        a, b = self.tokens.encode(pieces)
        for name, ids, length in (("a_tokens", a, self.tokens.a_len), ("b_tokens", b, self.tokens.b_len)):
            self.db.register("given", _intervals(ids, first, length))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.db.execute(ALIGNED)
        self.db.execute(PAIRS)
        own = [self.db.execute(f"SELECT piece, id, g FROM {x} ORDER BY piece, i").fetchnumpy() for x in ("a_in", "b_in")]
        groups, digest = _digests(*own, first, len(pieces))
        self.known.update(zip(pieces, zip(range(first, self.next), map(len, a), map(len, b), groups, digest)))

    def align(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, str]], dict[str, np.ndarray]]:
        """(tokens of A, of B, groups, digest) of each text, and doc, pair, times of all their pairs, sorted by the first two."""
        split = [pieces_of(text) if text else [] for text in texts]
        met = set(chain.from_iterable(split))
        new = sorted(met.difference(self.known))
        self.again |= met & self.known.keys()
        if new:
            self._add(new)
        facts, docs = [], []
        for own in split:
            found = list(map(self.known.__getitem__, own))
            number, n_a, n_b, groups, digest = zip(*found) if found else ((), (0,), (0,), (0,), ("",))
            if all(n_a):  # every piece has a byte, so one without tokens was not given back
                docs.append(number)
                facts.append((sum(n_a), sum(n_b), sum(groups), hashlib.sha256(";".join(digest).encode()).hexdigest()))
            else:
                docs.append(())
                facts.append((0, 0, 0, ""))
        n = np.array([len(x) for x in docs], np.int64)
        table = pa.table({"doc": pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), "piece": pa.array(np.fromiter(chain.from_iterable(docs), np.int32, int(n.sum())))})
        self.db.register("occurrences", table)
        pairs = self.db.execute(OF_DOCS).fetchnumpy()
        self.db.unregister("occurrences")
        # long pieces hardly recur and may have very many pairs
        if len(self.known) > PIECES or any(len(p) > PIECE_CHARS for p in new):
            self._forget()
        return facts, pairs


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """The tokenizers and their pieces, one a worker."""
    if (a_file, b_file) not in _loaded:
        _loaded[a_file, b_file] = Aligner(Tokens(a_file, b_file))
    return _loaded[a_file, b_file]


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, behind that number of bytes."""
    kind = next(w for w in (1, 2, 4, 8) if x.max(initial=0) < 1 << 8 * w)
    return bytes([kind]) + x.astype(f"<u{kind}").tobytes()


def _large(blob) -> np.ndarray:
    raw = memoryview(blob)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _rows(kind: str, n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of a row type, null where no column is given."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, types[t]) for c, t in fields], names=[c for c, _ in fields])


def _mixed(pair: np.ndarray) -> np.ndarray:
    """Pairs spread evenly over 32 bits."""
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)


def _aligned(docs: DataFrame, files: tuple[str, str], ranges: int) -> DataFrame:
    """DOCS: a row for each document, and rows of a chunk's distinct pairs for a range, both under the chunk's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = aligner(*files), TaskContext.get().partitionId(), 0
        met: list[np.ndarray] = []
        held = 0

        def requests() -> Iterator[pa.RecordBatch]:
            if not met:
                return
            pair, count = np.unique(np.concatenate(met), return_counts=True)
            met.clear()
            if not len(pair):
                return
            to = _mixed(pair) * ranges >> 32
            by = np.argsort(to, kind="stable")
            used, cut = np.unique(to[by], return_index=True)
            keys = [_small(np.diff(pair[by[a:b]], prepend=0)) for a, b in zip(cut, [*cut[1:], len(by)])]
            docs_ = [_small(count[by[a:b]]) for a, b in zip(cut, [*cut[1:], len(by)])]
            yield _rows(DOCS, len(used), chunk=pa.array(np.full(len(used), (part << 32) + at, np.int64)), range=pa.array(used.astype(np.int32)), keys=pa.array(keys, pa.binary()), docs=pa.array(docs_, pa.binary()))

        for batch in batches:
            for slice_ in slices(batch, "text", SLICE_BYTES):
                n = slice_.num_rows
                facts, pairs = own.align(slice_.column(1).to_pylist())
                doc, pair, times = (pairs[c].astype(np.int64) for c in ("doc", "pair", "times"))
                ends = np.searchsorted(doc, np.arange(n + 1))
                links = np.concatenate([[0], np.cumsum(times)])
                links = links[ends[1:]] - links[ends[:-1]]
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                a, b, g, sha = zip(*facts)
                yield _rows(
                    DOCS, n, chunk=pa.array(np.full(n, (part << 32) + at, np.int64)), doc_id=slice_.column(0), n_a=pa.array(a, pa.int64()), n_b=pa.array(b, pa.int64()), n_groups=pa.array(g, pa.int64()), n_links=pa.array(links), groups_sha256=pa.array(sha, pa.string()),
                    pairs=pa.array([_small(np.diff(pair[x:y], prepend=0)) for x, y in spans], pa.binary()), times=pa.array([_small(times[x:y]) for x, y in spans], pa.binary()),
                )
                met.append(pair)
                held += len(pair)
                if held > CHUNK_PAIRS:
                    yield from requests()
                    at, held = at + 1, 0
        yield from requests()

    own = docs.select(F.col(named(docs.columns[0])), F.col(named(docs.columns[1])))
    return own.mapInArrow(run, DOCS)


def _added(table: pa.Table) -> pa.Table:
    """What the chunks asked of a range: the documents of each pair, in the order asked; and the highest count of each A id here."""
    asked = [(np.cumsum(_large(k.as_buffer())), _large(d.as_buffer())) for k, d in zip(table["keys"].combine_chunks(), table["docs"].combine_chunks())]
    pair, at = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    total = np.bincount(at, np.concatenate([d for _, d in asked])).astype(np.int64)
    counts, done = [], 0
    for k, _ in asked:
        counts.append(_small(total[at[done : done + len(k)]]))
        done += len(k)
    a = pair // B_IDS
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    most = np.maximum.reduceat(total, first)
    answers = _rows(ANSWER, len(asked), chunk=table["chunk"].combine_chunks(), range=table["range"].combine_chunks(), counts=pa.array(counts, pa.binary()))
    return pa.Table.from_batches([answers, _rows(ANSWER, len(first), a=pa.array(a[first].astype(np.int32)), most=pa.array(most))])


def _scored(ranges: int, best: np.ndarray):
    """Documents of a chunk with its answers: the sums over their links."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = docs.filter(pa.compute.is_valid(docs["pairs"]))
        asked = docs.filter(pa.compute.is_valid(docs["range"]))
        of_range = dict(zip(asked["range"].to_pylist(), asked["keys"].combine_chunks() if asked.num_rows else ()))
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r, c in zip(answers["range"].to_pylist(), answers["counts"].combine_chunks() if answers.num_rows else ()):
            keys.append(np.cumsum(_large(of_range[r].as_buffer())))
            counts.append(_large(c.as_buffer()))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        is_best = counts == best[keys // B_IDS]
        n_best, total = [], []
        for pairs, times in zip(own["pairs"].combine_chunks(), own["times"].combine_chunks()):
            at, times = np.searchsorted(keys, np.cumsum(_large(pairs.as_buffer()))), _large(times.as_buffer())
            n_best.append(int(times[is_best[at]].sum()))
            total.append(int((times * counts[at]).sum()))
        kept = {c: own[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(kept | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": own["groups_sha256"]})

    return run


def align(docs: DataFrame, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    own = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))
    # a scan task's requests are a small part of its bytes; ranges are as many as tasks
    ranges = max(8, own.rdd.getNumPartitions())
    rows = scratch.table(_aligned(own, files or default_files(), ranges), "aligned")
    asked = rows.where("range IS NOT NULL").select("chunk", "range", "keys", "docs")
    answers = scratch.table(asked.groupBy("range").applyInArrow(_added, ANSWER), "answers")
    best = np.zeros(A_IDS, np.int64)
    # at most one row for each id of A
    for a, most in answers.where("a IS NOT NULL").groupBy("a").agg(F.max("most")).collect():
        best[a] = most
    told = answers.where("range IS NOT NULL").select("chunk", "range", "counts")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scored(ranges, best), RESULT)


def links(docs: DataFrame, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id pairs of the corpus: a, b, n (documents that hold them linked)."""
    own = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))
    rows = _aligned(own, files or default_files(), max(8, own.rdd.getNumPartitions()))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, d in zip(batch.column(0), batch.column(1)):
                pair, n = np.cumsum(_large(k.as_buffer())), _large(d.as_buffer())
                for x in range(0, len(pair), 1 << 16):
                    own = pair[x : x + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array((own // B_IDS).astype(np.int32)), pa.array((own % B_IDS).astype(np.int32)), pa.array(n[x : x + (1 << 16)])], names=["a", "b", "n"])

    found = rows.where("range IS NOT NULL").select("keys", "docs").mapInArrow(opened, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))
