"""Language identification with a byte convolutional network, written in numpy.

A text is lower-cased, its ASCII signs and digits become spaces, and its bytes
are cut in windows of fixed length, all of them. Filters of several widths slide
over learned byte vectors; each filter's maximum over the window feeds a softmax.
A text's languages are the windows' probabilities, weighted by their letters.

Training uses at most WINDOWS windows of labelled documents, dealt evenly over
the languages, of documents chosen by a hash of the id, at most PER_DOCUMENT of each,
spread over its text. These two bounds are parameters of the fit alone: every window
of every text is classified.

Defined results: a null text, or one without a letter, is `und` with score 0, and
so is every text when nothing is labelled. Ties go to the first language by name.
A null doc_id is not held out and not trained on. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .carry import named, with_rest

LENGTH = 192
WINDOWS = 12_000
PER_DOCUMENT = 6
WIDTHS = (3, 4, 5)
WIDEST = max(WIDTHS)
FILTERS = 16
VECTOR = 8
EPOCHS = 6
BLOCK = 512
AT_ONCE = 32
UNKNOWN = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[: 0x61] = _PLAIN[0x7B:0x80] = 0x20


def letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def windows(text: str) -> np.ndarray:
    """All windows of a text, padded with spaces."""
    raw = _PLAIN[np.frombuffer(text.lower().encode(), np.uint8)]
    n = max(1, -(-len(raw) // LENGTH))
    out = np.full(n * LENGTH, 0x20, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, LENGTH)


class Network:
    """Byte vectors, convolutions of several widths, max pooling, softmax.

    All filters stand side by side in one matrix over WIDEST bytes, a narrow one with
    zeros behind it, so a window is one matrix product. Past a window's end bytes are
    zero vectors.
    """

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.mask = np.concatenate([np.repeat(np.arange(WIDEST * VECTOR) < w * VECTOR, FILTERS).reshape(-1, FILTERS) for w in WIDTHS], 1)
        scale = np.concatenate([np.full(FILTERS, (2 / (w * VECTOR)) ** 0.5) for w in WIDTHS])
        self.params = {
            "bytes": rng.normal(0, 0.5, (256, VECTOR)),
            "conv": rng.normal(0, 1, self.mask.shape) * scale * self.mask,
            "bias": np.zeros(self.mask.shape[1]),
            "out": rng.normal(0, 0.1, (self.mask.shape[1], len(labels))),
            "out_bias": np.zeros(len(labels)),
        }
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def _patches(self, x: np.ndarray) -> np.ndarray:
        """The vectors of the WIDEST bytes from each place of each window on."""
        e = np.zeros((len(x), (LENGTH + WIDEST - 1) * VECTOR), np.float32)
        e[:, : LENGTH * VECTOR] = self.params["bytes"].take(x, 0).reshape(len(x), -1)
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (len(x), LENGTH, WIDEST * VECTOR), (e.strides[0], VECTOR * e.itemsize, e.itemsize)))

    def _convolved(self, patches: np.ndarray) -> np.ndarray:
        return (patches.reshape(-1, patches.shape[2]) @ self.params["conv"]).reshape(len(patches), LENGTH, -1)

    def _softmax(self, act: np.ndarray) -> np.ndarray:
        z = act @ self.params["out"] + self.params["out_bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        # a few windows at a time, so that what is convolved stays in the cache
        pooled = [self._convolved(self._patches(x[a : a + AT_ONCE])).max(1) for a in range(0, len(x), AT_ONCE)]
        return self._softmax(np.maximum(np.concatenate(pooled) + self.params["bias"], 0))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(x)
        patches = self._patches(x)
        c = self._convolved(patches)
        at = c.argmax(1)
        top = np.take_along_axis(c, at[:, None], 1)[:, 0]
        raw = top + p["bias"]
        act = np.maximum(raw, 0)
        d = self._softmax(act)
        d[np.arange(n), y] -= 1
        d /= n
        g = (d @ p["out"].T) * (raw > 0)
        own = patches[np.arange(n)[:, None], at]  # n, filters, bytes and their vectors
        back = (g[:, :, None] * p["conv"].T).reshape(n, -1, WIDEST, VECTOR)
        place = at[:, :, None] + np.arange(WIDEST)
        byte = np.where(place < LENGTH, x[np.arange(n)[:, None, None], np.minimum(place, LENGTH - 1)].astype(np.int64), 256)
        flat = (byte[..., None] * VECTOR + np.arange(VECTOR)).ravel()
        of_bytes = np.bincount(flat, back.ravel(), 257 * VECTOR).reshape(257, VECTOR)[:256]
        return {"out": act.T @ d, "out_bias": d.sum(0), "bias": g.sum(0), "conv": np.einsum("nf,nfk->kf", g, own, optimize=True) * self.mask, "bytes": of_bytes}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> "Network":
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 64):
                step += 1
                own = order[a : a + 64]
                for k, g in self._gradients(x[own], y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.params[k] -= (rate * 0.5**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(labelled: DataFrame) -> Network | None:
    """A network for the languages of labelled (doc_id, text, lang); None if there are none."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    wanted = max(1, WINDOWS // (PER_DOCUMENT * len(labels)))
    # about twice as many by hash as wanted, however often an id repeats; then exactly the first by hash and windows
    share = F.create_map(*[F.lit(v) for k in labels for v in (k, float(min(1, 2 * wanted / counts[k])))])
    key = F.xxhash64("doc_id")
    chosen = usable.where(F.pmod(key, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)).select("lang", key.alias("key"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2):
                text = text.as_py()
                own = windows(text) if letters(text) else np.empty((0, LENGTH), np.uint8)
                step = max(1, len(own) // PER_DOCUMENT)
                found.append(own[::step][:PER_DOCUMENT].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["lang", "key", "windows"])

    first = Window.partitionBy("lang").orderBy("key", "windows")
    found = scratch.table(chosen.mapInArrow(cut, "lang string, key long, windows binary"), "windows")
    ranked = found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= wanted)
    rows: dict[str, list[tuple[int, bytes]]] = {k: [] for k in labels}
    for r in ranked.collect():
        rows[r["lang"]].append((r["key"], bytes(r["windows"])))
    x, y = [np.empty((0, LENGTH), np.uint8)], [np.empty(0, np.int64)]
    for i, k in enumerate(labels):
        own = np.frombuffer(b"".join(w for _, w in sorted(rows[k])), np.uint8).reshape(-1, LENGTH)
        x.append(own)
        y.append(np.full(len(own), i))
    x, y = np.concatenate(x), np.concatenate(y)
    return Network(labels).fit(x, y) if len(x) else None


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per document: doc_id, lang_pred, score; with carry also text, and rest with all other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score = [UNKNOWN] * n, np.zeros(n)
            held: list[np.ndarray] = []
            owner: list[int] = []
            totals = np.zeros((n, len(network.labels) if network else 0))

            def flush() -> None:
                x = np.concatenate(held)
                of = np.repeat(owner, [len(h) for h in held])
                for a in range(0, len(x), BLOCK):
                    part = x[a : a + BLOCK]
                    weight = (part != 0x20).sum(1) + 1e-6
                    np.add.at(totals, of[a : a + BLOCK], network.probabilities(part) * weight[:, None])
                held.clear()
                owner.clear()

            for d, text in enumerate(batch.column(1)):
                text = text.as_py()
                if network and letters(text):
                    held.append(windows(text))
                    owner.append(d)
                    if sum(map(len, held[-64:])) > 2 * BLOCK or len(held) >= 64:
                        flush()
            if held:
                flush()
            if network:
                sums = totals.sum(1)
                for d in np.flatnonzero(sums > 0):
                    best = int(totals[d].argmax())
                    pred[d], score[d] = network.labels[best], min(1.0, totals[d, best] / sums[d])
            kept = [batch.column(k) for k in (1, 2)] if carry else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score), *kept], names=["doc_id", "lang_pred", "score", "text", "rest"][: 3 + len(kept)])

    own, rest = with_rest(docs, id_col, text_col)
    if carry:
        return own.mapInArrow(run, f"doc_id long, lang_pred string, score double, text string, rest {rest}")
    return own.drop("rest").mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from the labelled documents that are not held out."""
    own = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"), F.col(named(lang_col)).cast("string").alias("lang"))
    return train(own.where(~held_out(F.col("doc_id"))))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = identify(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
