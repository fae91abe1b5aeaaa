"""Fill-in-middle transformation of documents, on ropes.

A text is a rope: a balanced tree whose leaves hold up to LEAF code points and whose
nodes cache how many units and code points are below. Units are runs of ASCII letters
and single other characters. A document's id decides two unit ranks and a form; the
rope is split at the ranks, and the three subtrees are put together again in another
order, with a mark before each:

    psm    <P> prefix <S> suffix <M> middle
    spm    <S> suffix <P> prefix <M> middle
    plain  the text

A unit may cross leaves: a leaf counts the units that begin in it, so a unit is counted
once and a split at rank k is the place where unit k begins. The inverse makes a rope of
the output, splits it at the code points of the marks and joins the parts in text order.

Defined results: a null text is empty; an empty text is plain with no units. A text that
holds a mark is plain, so an output that is not plain holds each mark once. A null doc_id
hashes as no digits. Repeated rows have equal results, repeated ids with other texts their
own. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import named

LEAF = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: of a hundred texts so many keep a form of their own, and of those so many come suffix first
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1
#: text sent on in one batch of rows
BATCH_CHARS = 4 << 20


class Leaf:
    """A piece of text; inside says that it begins within a unit of the leaf before."""

    __slots__ = ("text", "inside", "units", "chars")

    def __init__(self, text: str, inside: bool, units: int):
        self.text, self.inside, self.units, self.chars = text, inside, units, len(text)

    def starts(self) -> np.ndarray:
        """Where its units begin."""
        return np.flatnonzero(_begins(self.text, self.inside))


class Node:
    __slots__ = ("left", "right", "units", "chars")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.chars = left.units + right.units, left.chars + right.chars


Rope = Leaf | Node
NOTHING = Leaf("", False, 0)


def _begins(text: str, inside: bool = False) -> np.ndarray:
    """For each code point whether a unit begins there."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - 97 < 26) & (points < 128)  # unsigned: what is below "a" is large
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    if inside and len(points):
        begins[0] = not letter[0]
    return begins


def rope(text: str) -> Rope:
    """A balanced rope of a text."""
    if not text:
        return NOTHING
    begins = _begins(text)
    at = np.arange(0, len(text), LEAF)
    units = np.add.reduceat(begins.astype(np.int64), at).tolist()
    row: list[Rope] = [Leaf(text[a : a + LEAF], not begins[a], n) for a, n in zip(at.tolist(), units)]
    while len(row) > 1:
        row = [Node(*row[k : k + 2]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
    return row[0]


def joined(*parts: Rope) -> Rope:
    """The parts one after the other; their units must not run into each other."""
    out = NOTHING
    for part in parts:
        if part.chars:
            out = Node(out, part) if out.chars else part
    return out


def _split(tree: Rope, rank: int, by_units: bool) -> tuple[Rope, Rope]:
    if isinstance(tree, Leaf):
        if by_units:
            starts = tree.starts()
            at = int(starts[rank]) if rank < len(starts) else tree.chars
            before, inside = min(rank, tree.units), False
        else:
            at = rank
            before = int(_begins(tree.text[:at], tree.inside).sum())
            inside = at < tree.chars and not _begins(tree.text[max(0, at - 1) : at + 1], tree.inside if at == 0 else False)[-1]
        return Leaf(tree.text[:at], tree.inside, before), Leaf(tree.text[at:], inside, tree.units - before)
    here = tree.left.units if by_units else tree.left.chars
    if rank < here:
        a, b = _split(tree.left, rank, by_units)
        return a, joined(b, tree.right)
    a, b = _split(tree.right, rank - here, by_units)
    return joined(tree.left, a), b


def split_units(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    return (tree, NOTHING) if rank >= tree.units else _split(tree, rank, True)


def split_chars(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` code points, and the rest."""
    return (tree, NOTHING) if rank >= tree.chars else _split(tree, rank, False)


def text_of(tree: Rope) -> str:
    out: list[str] = []
    todo = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, Leaf):
            out.append(x.text)
        else:
            todo += (x.right, x.left)
    return "".join(out)


def numbers(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The four numbers that decide a document's ranks and form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def arranged(doc_id: int | None, text: str, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of a document."""
    tree = rope(text)
    h1, h2, h3, h4 = numbers(doc_id, seed)
    if not text or h3 % 100 >= CHANGED or any(m in text for m in MARKS):
        return tree.units, "plain", None, None, text
    low, high = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    head, suffix = split_units(tree, high)
    prefix, middle = split_units(head, low)
    p, s, m = (Leaf(x, False, 3) for x in MARKS)
    if h4 % 100 < SUFFIX_FIRST:
        return tree.units, "spm", prefix.chars, middle.chars, text_of(joined(s, suffix, p, prefix, m, middle))
    return tree.units, "psm", prefix.chars, middle.chars, text_of(joined(p, prefix, s, suffix, m, middle))


def restored_text(form: str, output: str) -> str:
    """The text of an output: its rope is split at the marks, and the parts are joined in text order."""
    if form == "plain":
        return output
    tree = rope(output)
    parts: dict[str, Rope] = {}
    for mark in (MIDDLE, *((PREFIX, SUFFIX) if form == "spm" else (SUFFIX, PREFIX))):  # from the last to the first
        tree, part = split_chars(tree, output.index(mark))
        parts[mark] = split_chars(part, len(mark))[1]
    return text_of(joined(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


def transform(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output."""
    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                made.append((doc_id, *arranged(doc_id, text, seed)))
                held += len(text)
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)
                    made, held = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    own = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))
    return own.mapInArrow(run, kind)


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of transform() with the text rebuilt from form and output alone, as `restored`."""
    kept = [c for c in transformed.columns if c not in ("form", "output")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, output = (batch.column(batch.schema.get_field_index(c)) for c in ("form", "output"))
            made = pa.array([restored_text(f.as_py(), o.as_py()) for f, o in zip(form, output)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), form, output, made], names=[*kept, "form", "output", "restored"])

    own = transformed.select(*[F.col(named(c)) for c in kept], "form", "output")
    return own.mapInArrow(run, ", ".join(f"{named(f.name)} {f.dataType.simpleString()}" for f in own.schema) + ", restored string")


def digest(transformed: DataFrame) -> DataFrame:
    """transform() and restore() with hashes in place of the texts."""
    return restore(transformed).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
