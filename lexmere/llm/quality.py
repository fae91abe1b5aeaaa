"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a vector of terms: hashed byte trigrams, and one term for a word that
repeats the word before it, which trigrams cannot tell from its neighbours. Terms
count by logarithm and rarity; vectors have unit length. A truncated singular value decomposition of the
labelled vectors gives a space of RANK dimensions. Every document is projected,
its cosines with all labelled vectors are computed in blocks, and its NEIGHBOURS
nearest vote with their similarity.

At most SAMPLE labelled rows are used, half of each label, chosen by a hash of
the id; votes are weighted back to the labels' shares among all labelled rows.
They, and twice as many ids to find them, are all that is broadcast.

Defined results: a null or empty text, and one of terms that no labelled text has,
has no direction; its score is the share of label 1, as every score is when only one label is known; with no labels at all
scores are 0.5. Repeated label rows count as often as they stand there. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .carry import named
from .textscan import NON_SPACE, arrow_bytes, scan, slices

TRIGRAMS = 4096
FEATURES = TRIGRAMS + 1
#: the repetition term stands against hundreds of trigrams
REPEAT_WEIGHT = 8
RANK = 64
SAMPLE = 6000
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 256
SLICE_BYTES = 1 << 20


def trigram_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of a text's byte trigrams, hashed to TRIGRAMS numbers."""
    if not len(raw):
        return np.zeros(TRIGRAMS, np.int64)
    if len(raw) < 3:
        raw = np.concatenate([raw, np.zeros(3 - len(raw), np.uint8)])
    x = raw.astype(np.uint32)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return np.bincount((key * np.uint32(2654435761)) >> np.uint32(20), minlength=TRIGRAMS)


class Terms:
    """The term counts of a slice's texts, made for a range of them at a time."""

    def __init__(self, texts: pa.Array):
        self.raw, self.off = arrow_bytes(texts)
        w = scan(texts, NON_SPACE)
        again = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        self.repeats = np.bincount(w.doc[1:][again], minlength=len(texts))

    def counts(self, a: int, b: int) -> np.ndarray:
        rows = [trigram_counts(self.raw[self.off[d] : self.off[d + 1]]) for d in range(a, b)]
        return np.concatenate([np.stack(rows), self.repeats[a:b, None]], 1)


def _sampled_features(rows: DataFrame) -> list[tuple[int, int, bytes]]:
    """(key, label, features) of the first rows of each label by key: at most SAMPLE in all, however often an id stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, made = Terms(batch.column(2)), []
            for d in range(batch.num_rows):
                c = terms.counts(d, d + 1)[0]
                at = np.flatnonzero(c)
                made.append(np.concatenate([at, c[at]]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["key", "label", "f"])

    found = scratch.table(rows.mapInArrow(run, "key long, label int, f binary"), "features")
    return [(r[0], r[1], bytes(r[2])) for label in (0, 1) for r in found.where(F.col("label") == label).orderBy("key", "f").limit(SAMPLE // 2).collect()]


class Voter:
    """The labelled vectors and the way into their space."""

    def __init__(self, counts: np.ndarray, label: np.ndarray, share: float, rank: int = RANK, seed: int = 11):
        self.share = share
        rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
        self.rarity = rarity.astype(np.float32)
        self.rarity[TRIGRAMS:] *= REPEAT_WEIGHT
        a = self._weighted(counts)
        rng = np.random.default_rng(seed)
        rank = min(rank, len(counts))
        q = a @ rng.normal(size=(a.shape[1], rank + 16)).astype(np.float32)
        for _ in range(3):
            q, _ = np.linalg.qr(q)
            z, _ = np.linalg.qr(a.T @ q)
            q = a @ z
        q, _ = np.linalg.qr(q)
        _, _, vt = np.linalg.svd(q.T @ a, full_matrices=False)
        self.axes = np.ascontiguousarray(vt[:rank].T.astype(np.float32))
        self.vectors = self._unit(a @ self.axes)
        self.label = label.astype(np.float32)
        own = float(label.mean())
        # a vote counts for as many labelled rows as its sample row stands for
        self.vote = np.where(label == 1, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9)).astype(np.float32)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts).astype(np.float32) * self.rarity)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        own = self._unit(self._weighted(counts) @ self.axes)
        cosine = own @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(own), 1))
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS * self.vote[near]
        total = weight.sum(1)
        score = (weight * self.label[near]).sum(1) / np.maximum(total, 1e-30)
        return np.where((counts.sum(1) > 0) & (total > 1e-30), score, self.share).clip(0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Voter | float:
    """A voter from the labels that are not held out; the share of label 1 where there is nothing to tell apart."""
    own = labels.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(label_col)).cast("int").alias("label"))
    own = own.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id")))
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    # twice as many labels as are wanted, as some have no text
    keyed = own.withColumn("key", F.xxhash64("doc_id"))
    chosen = keyed.where("label = 0").orderBy("key").limit(SAMPLE).unionByName(keyed.where("label = 1").orderBy("key").limit(SAMPLE))
    texts = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))
    picked = _sampled_features(texts.join(F.broadcast(chosen), "doc_id").select("key", "label", F.coalesce("text", F.lit("")).alias("text")))
    known = {r[1] for r in picked}
    if len(known) < 2:
        return counts[1] / total
    dense = np.zeros((len(picked), FEATURES), np.float32)
    for i, (_, _, f) in enumerate(picked):
        at, c = np.frombuffer(f, "<u4").reshape(2, -1)
        dense[i, at] = c
    return Voter(dense, np.array([r[1] for r in picked]), counts[1] / total)


def score(docs: DataFrame, voter: Voter | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                terms = Terms(part.column(1))
                out = np.empty(part.num_rows)
                for a in range(0, part.num_rows, BLOCK):
                    b = min(part.num_rows, a + BLOCK)
                    out[a:b] = voter if isinstance(voter, float) else voter.scores(terms.counts(a, b))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out)], names=["doc_id", "score"])

    own = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
