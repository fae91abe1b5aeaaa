"""Toxicity scores by weak supervision: voters, a generative label model, a linear classifier.

1. Terms: words, and the first 3 to 8 bytes of words, that stand in labelled toxic texts far
   more often than in clean ones. They are counted over a sample of labelled rows.
2. Voters: a lexicon for each kind of term, strong and weak terms apart, one of common insults,
   and patterns (masked letters, shouting, runs of exclamation marks, stutter). A lexicon knows
   how often its terms come in toxic and in clean texts and votes where a text's count is clearly
   likelier under one of them; it abstains in between. A pattern votes toxic or abstains.
3. Label model: votes come from an unseen label. Each vote's chance under both labels (the
   voters' accuracies) and what votes share beyond the label (their correlations) are read from
   the second moments of the votes of all texts that may be learned from, with the given labels as
   one more voter. Pairs of votes that agree more than the label explains are correlated: their
   covariance is kept in the model, and they are left out when accuracies are fitted. The
   posterior of a label weighs votes by the inverse of that covariance, so voters that repeat
   each other count about once.
4. Classifier: logistic regression on the rates of all terms, trained on the posterior labels of
   the sample, scores every text.

Bounds of the fit: SAMPLE labelled rows, half of each label, chosen by a hash of
the id; TERMS terms. Moments are over all texts that are not held out, scores over all texts.

Defined results: null and empty texts have no terms and get the classifier's score of nothing. With
labels of one kind alone every score is that label; with none at all scores are 0.5. A row of labels
without an id or with a label other than 0 and 1 is not learned from; repeated rows count as often as
they stand there. A null doc_id is not held out. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .carry import named
from .textscan import BYTE_KEY, LOWER, SEGMENT, _powers, arrow_bytes, mix, slices

SAMPLE = 12_000
TERMS = 4_000
#: a term is in so many sampled toxic texts at least, and so many times likelier there (as a logarithm, in standard errors)
LEAST_TEXTS, LEAST_LIFT, LEAST_Z = 3, 0.7, 1.5
PREFIXES = (3, 4, 5, 6, 7, 8)
#: a lexicon votes where the likelihoods differ by so much
SURE = 2.0
#: correlation beyond the label above which two votes are taken as dependent
DEPENDENT = 0.05
#: log-odds that a given label adds to the votes: it is wrong about once in a thousand
TRUST = 7.0
THRESHOLD = 0.7
SLICE_BYTES = 1 << 20

# fixed values: common insults
INSULTS = {
    "en": "idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting jerk creep imbecile dimwit",
    "de": "idiot dummkopf trottel depp blödmann abschaum versager widerlich erbärmlich wertlos schwachkopf",
    "fr": "idiot idiote imbécile crétin abruti ordure minable pathétique dégoûtant débile",
    "es": "idiota imbécil estúpido estúpida basura escoria patético patética asqueroso inútil tonto",
}
PATTERNS = ("masked", "shouting", "exclaiming", "stuttering")

U = np.uint64
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True
MASK = np.zeros(256, bool)
MASK[[ord(c) for c in "*#@$%"]] = True
KIND_KEY = mix(np.arange(1, len(PREFIXES) + 2, dtype=U) * U(0x9E3779B97F4A7C15))
#: lexicons: of words and of each prefix, strong and weak; then the insults
LEXICONS = 2 * len(KIND_KEY) + 1
VOTERS = LEXICONS + len(PATTERNS)


class Terms:
    """The words of a slice of texts, the hashes of their terms, and counts of patterns."""

    def __init__(self, texts: pa.Array):
        raw, off = arrow_bytes(texts)
        buf = LOWER[raw]
        if len(buf) > 1:  # capitals of Latin-1 in UTF-8
            buf[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)] += 0x20
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = LETTER[buf]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(buf))]
        begins[cuts] |= inside[1:-1][cuts]
        ends[cuts - 1] |= inside[1:-1][cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.texts = len(off) - 1
        self.doc = np.searchsorted(off[1:], self.start, "right")
        self.n = np.bincount(self.doc, minlength=self.texts)
        self.buf, self.raw, self.off = buf, raw, off

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, word, hash) of all terms: kind 0 is the word, k the first PREFIXES[k - 1] bytes of a longer one."""
        size = self.end - self.start
        out = [np.empty(len(size), U) for _ in KIND_KEY]
        at = 0
        with np.errstate(over="ignore"):
            while at < len(size):
                origin = int(self.start[at])
                to = max(at + 1, int(np.searchsorted(self.end, origin + SEGMENT, "right")))
                n = int(self.end[to - 1]) - origin
                power, inverse = _powers(n + 1)
                total = np.zeros(n + 1, U)
                np.cumsum(BYTE_KEY[self.buf[origin : origin + n]] * power[:n], out=total[1:])
                s, e = self.start[at:to] - origin, self.end[at:to] - origin
                for k, own in enumerate(out):
                    last = e if k == 0 else np.minimum(s + PREFIXES[k - 1], e)
                    own[at:to] = mix((total[last] - total[s]) * inverse[s] ^ KIND_KEY[k])
                at = to
        for k, own in enumerate(out):
            words = np.arange(len(size)) if k == 0 else np.flatnonzero(size > PREFIXES[k - 1])
            yield k, words, own[words]

    def patterns(self) -> np.ndarray:
        """For each text whether each of PATTERNS is there."""
        found = np.zeros((self.texts, len(PATTERNS)), bool)

        def mark(k: int, places: np.ndarray) -> None:
            found[np.unique(np.searchsorted(self.off[1:], places, "right")), k] = True

        letter, mask = LETTER[self.buf], MASK[self.buf]
        mark(0, 1 + np.flatnonzero(mask[1:-1] & letter[:-2] & letter[2:]))
        upper = np.concatenate([[0], np.cumsum((self.raw >= 65) & (self.raw <= 90))])
        size = self.end - self.start
        loud = np.bincount(self.doc[(size >= 3) & (upper[self.end] - upper[self.start] == size)], minlength=self.texts)
        found[:, 1] = (loud >= 3) & (10 * loud >= self.n)
        mark(2, np.flatnonzero((self.buf[1:] == 0x21) & (self.buf[:-1] == 0x21)))
        _, _, word = next(self.hashes()) if len(size) else (0, 0, np.empty(0, U))
        same = (word[2:] == word[1:-1]) & (word[1:-1] == word[:-2]) & (self.doc[2:] == self.doc[:-2])
        found[np.unique(self.doc[2:][same]), 3] = True
        return found


def _insults() -> np.ndarray:
    return np.unique(next(Terms(pa.array(sorted({w for x in INSULTS.values() for w in x.split()}))).hashes())[2])


class Voters:
    """Terms with their lexicon, and how each lexicon votes."""

    def __init__(self, names: np.ndarray, kind: np.ndarray, strong: np.ndarray, solid: np.ndarray):
        by = np.argsort(names)
        self.names, self.solid = names[by], solid[by]
        self.lexicon = (2 * kind + ~strong)[by]
        self.near = np.zeros(1 << 16, bool)  # most words are told off by a glance
        self.near[(self.names >> U(48)).astype(np.int64)] = True
        self.insults = _insults()
        self.near_insult = np.zeros(1 << 16, bool)
        self.near_insult[(self.insults >> U(48)).astype(np.int64)] = True
        self.high = np.full(LEXICONS, 1e-9)
        self.low = np.full(LEXICONS, 1e-9)

    def counted(self, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the texts' terms, sorted, and the counts of each lexicon in each text."""
        docs, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        lexicons = np.zeros((terms.texts, LEXICONS))
        for kind, words, hashes in terms.hashes():
            if kind == 0:
                some = np.flatnonzero(self.near_insult[(hashes >> U(48)).astype(np.int64)])
                some = some[np.isin(hashes[some], self.insults)]
                lexicons[:, -1] = np.bincount(terms.doc[words[some]], minlength=terms.texts)
            some = np.flatnonzero(self.near[(hashes >> U(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.names, hashes[some]), max(0, len(self.names) - 1))
            hit = self.names[at] == hashes[some] if len(self.names) else np.zeros(len(some), bool)
            docs.append(terms.doc[words[some[hit]]])
            found.append(at[hit])
        doc, term = np.concatenate(docs), np.concatenate(found)
        np.add.at(lexicons, (doc, self.lexicon[term]), 1)
        pair, count = np.unique(doc * max(1, len(self.names)) + term, return_counts=True)
        return pair // max(1, len(self.names)), pair % max(1, len(self.names)), count, lexicons

    def without_own(self, label, doc, term, count, lexicons) -> np.ndarray:
        """The lexicons' counts in sampled texts without the terms that a toxic text itself has made terms: a new text shows no others."""
        kept = (label[doc] != 1) | self.solid[term]
        again = np.zeros_like(lexicons)
        again[:, -1] = lexicons[:, -1]
        np.add.at(again, (doc[kept], self.lexicon[term[kept]]), count[kept])
        return again

    def calibrate(self, n: np.ndarray, lexicons: np.ndarray, label: np.ndarray) -> None:
        """How often each lexicon's terms come for a word of toxic and of clean texts."""
        for value, rate in ((1, "high"), (0, "low")):
            own = label == value
            setattr(self, rate, (lexicons[own].sum(0) + 0.5) / (n[own].sum() + 1000.0))

    def votes(self, n: np.ndarray, lexicons: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """1, 0 or -1 of each voter for each text."""
        told = lexicons * np.log(self.high / self.low) - n[:, None] * (self.high - self.low)
        told[:, self.high <= self.low] = 0
        return np.concatenate([(told > SURE).astype(np.int8) - (told < -SURE), patterns.astype(np.int8)], 1)


def indicators(votes: np.ndarray) -> np.ndarray:
    """Votes as two columns a voter: for, against."""
    return np.concatenate([votes > 0, votes < 0], 1).astype(np.float64)


class LabelModel:
    """The voters' accuracies and correlations, from the moments of their votes.

    With share p of toxic texts, votes f have the covariance C + p(1-p) d d', where d is
    how much likelier each vote is under label 1 than under 0, and C, what the votes share within a
    label, is 0 but for pairs that depend on each other. The given label is the last voter;
    its moments with the others come from labelled texts.
    """

    def __init__(self, mean: np.ndarray, second: np.ndarray, with_label: np.ndarray, share: float):
        k = len(mean)
        self.share, self.mean = share, mean
        spread = share * (1 - share)
        s = np.zeros((k + 1, k + 1))
        s[:k, :k] = second - np.outer(mean, mean)
        s[k, :k] = s[:k, k] = with_label
        s[k, k] = spread
        scale = np.sqrt(np.maximum(np.diag(s), 1e-9))
        own = np.arange(k) % (k // 2)
        free = np.ones((k + 1, k + 1), bool)
        free[:k, :k] = own[:, None] != own  # a voter's two columns exclude each other
        np.fill_diagonal(free, False)
        start = np.concatenate([with_label, [spread]]) / spread
        d = start.copy()
        for _ in range(4):
            left = (s - spread * np.outer(d, d)) / np.outer(scale, scale)
            use = free & (np.abs(left) <= DEPENDENT)
            use[k, :k] = use[:k, k] = True
            for _ in range(50):
                for i in range(k):
                    weight = use[i] / scale**2
                    d[i] = (weight * s[i] * d).sum() / (spread * (weight * d * d).sum() + 1e-12)
        left = s - spread * np.outer(d, d)
        self.dependent = free & (np.abs(left) > DEPENDENT * np.outer(scale, scale))
        c = np.where(self.dependent | ~free, left, 0.0)[:k, :k]
        self.chance = np.clip(np.stack([mean - share * d[:k], mean + (1 - share) * d[:k]]), 0, 1)
        smooth = np.clip(self.chance, 0.01, 0.99)
        c[np.diag_indices(k)] = np.maximum(np.diag(left)[:k], (1 - share) * (smooth * (1 - smooth))[0] + share * (smooth * (1 - smooth))[1])
        value, axis = np.linalg.eigh(c / np.outer(scale[:k], scale[:k]))
        c = (axis * np.maximum(value, 0.05)) @ axis.T * np.outer(scale[:k], scale[:k])
        self.weight = np.linalg.solve(c, d[:k])
        self.bias = float(np.log(share / (1 - share)) - self.weight @ (mean + (0.5 - share) * d[:k]))

    def calibrate(self, votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Scales the log-odds so that they are as sure as they are right on given labels: votes are no normal variables."""
        raw = indicators(votes) @ self.weight + self.bias
        spread = max(1e-9, float(np.sqrt((weight * raw * raw).sum() / weight.sum())))
        x = np.stack([raw / spread, np.ones(len(raw))], 1)
        at = np.array([1.0, 0.0])
        for _ in range(25):  # Newton's steps, held back a little by a prior
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            g = x.T @ (weight * (p - label)) / weight.sum() + 1e-3 * (at - [1.0, 0.0])
            h = (x * (weight * p * (1 - p) / weight.sum())[:, None]).T @ x + 1e-3 * np.eye(2)
            at = at - np.clip(np.linalg.solve(h, g), -2, 2)
        self.weight, self.bias = self.weight * at[0] / spread, self.bias * at[0] / spread + at[1]

    def accuracies(self) -> np.ndarray:
        """How often each voter is right where it votes; 0.5 where it never does."""
        h = self.chance.shape[1] // 2
        right = self.share * self.chance[1, :h] + (1 - self.share) * self.chance[0, h:]
        wrong = (1 - self.share) * self.chance[0, :h] + self.share * self.chance[1, h:]
        return np.where(right + wrong > 1e-9, right / np.maximum(right + wrong, 1e-12), 0.5)

    def posterior(self, votes: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """The chance of label 1 given the votes and, where there is one, the given label."""
        z = indicators(votes) @ self.weight + self.bias
        if label is not None:
            z = z + np.where(label == 1, TRUST, -TRUST)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Logistic regression on the rates of terms and lexicons, and on the length of a text."""

    def __init__(self, terms: int):
        self.terms = terms
        self.theta = np.zeros(terms + LEXICONS + 2)
        self.scale = np.ones(len(self.theta))
        self.bias = 0.0

    def _cells(self, n, doc, term, count, lexicons):
        root = np.sqrt(np.maximum(n, 1))
        of, lex = np.nonzero(lexicons)
        every = np.arange(len(n))
        rows = np.concatenate([doc, of, every, every])
        cols = np.concatenate([term, self.terms + lex, np.full(len(n), len(self.theta) - 2), np.full(len(n), len(self.theta) - 1)])
        return rows, cols, np.concatenate([count / root[doc], lexicons[of, lex] / root[of], root, 1 / root])

    def logits(self, n, doc, term, count, lexicons) -> np.ndarray:
        rows, cols, x = self._cells(n, doc, term, count, lexicons)
        return np.bincount(rows, x * (self.theta / self.scale)[cols], minlength=len(n)) + self.bias

    def fit(self, n, doc, term, count, lexicons, target, weight, steps: int = 300, rate: float = 0.05, penalty: float = 1e-4) -> "Linear":
        """Adam on the cross-entropy with soft targets."""
        rows, cols, x = self._cells(n, doc, term, count, lexicons)
        square = np.bincount(cols, x * x, minlength=len(self.theta)) / max(1, len(n))
        self.scale = np.maximum(np.sqrt(square), 0.02)
        x = x / self.scale[cols]
        m, v, mb, vb = np.zeros_like(self.theta), np.zeros_like(self.theta), 0.0, 0.0
        weight = weight / weight.sum()
        for t in range(1, steps + 1):
            z = np.bincount(rows, x * self.theta[cols], minlength=len(n)) + self.bias
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
            g, gb = np.bincount(cols, x * off[rows], minlength=len(self.theta)) + penalty * self.theta, off.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            self.theta = self.theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
        return self


class Scorer:
    """What is sent to the tasks that score."""

    def __init__(self, voters: Voters, model: LabelModel, linear: Linear):
        self.voters, self.model, self.linear = voters, model, linear

    def scores(self, texts: pa.Array) -> np.ndarray:
        terms = Terms(texts)
        doc, term, count, lexicons = self.voters.counted(terms)
        z = self.linear.logits(terms.n, doc, term, count, lexicons)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"))


def _mined(sample: DataFrame, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind, strong, solid) of the terms, from the texts of sample rows (label, text) that have a label; solid ones are terms without any one of their toxic texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                label = part.column(0).to_numpy(zero_copy_only=False)
                terms = Terms(part.column(1))
                for kind, words, hashes in terms.hashes():
                    name, at = np.unique(hashes, return_inverse=True)
                    pair = np.unique(at.astype(np.int64) * terms.texts + terms.doc[words])  # a text counts once
                    of, toxic_ = pair // max(1, terms.texts), label[pair % max(1, terms.texts)] == 1
                    pos, every = np.bincount(of, toxic_, len(name)).astype(np.int64), np.bincount(of, minlength=len(name))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.full(len(name), kind, np.int32)), pa.array(pos), pa.array(every - pos)], names=["term", "kind", "pos", "neg"])

    counted = sample.select("label", "text").mapInArrow(run, "term long, kind int, pos long, neg long")
    summed = counted.groupBy("term", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST_TEXTS)
    lift = F.log(((F.col("pos") + 0.1) / (toxic + 0.2)) / ((F.col("neg") + 0.1) / (clean + 0.2)))
    z = (lift - LEAST_LIFT) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    found = summed.withColumn("z", F.round(z, 9)).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    kind = np.array([r["kind"] for r in found], np.int64)
    rank = np.zeros(len(found))
    for k in np.unique(kind):  # the upper half of each kind is strong
        own = np.flatnonzero(kind == k)
        rank[own] = np.arange(len(own)) / len(own)
    pos, neg = (np.array([r[c] for r in found], float) for c in ("pos", "neg"))
    less = pos - 1
    again = (np.log(((less + 0.1) / (toxic + 0.2)) / ((neg + 0.1) / (clean + 0.2))) - LEAST_LIFT) / np.sqrt(1 / (less + 0.5) + 1 / (neg + 0.5))
    return np.array([r["term"] for r in found], np.int64).view(U), kind, rank < 0.5, (less >= LEAST_TEXTS) & (again > LEAST_Z)


def _sampled(own: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the labelled rows that are learned from."""
    keyed = labels.withColumn("key", F.xxhash64("doc_id"))
    chosen = keyed.where("label = 0").orderBy("key", "doc_id").limit(SAMPLE // 2).unionByName(keyed.where("label = 1").orderBy("key", "doc_id").limit(SAMPLE // 2))
    of_label = own.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id").select("doc_id", "label", "text").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * SAMPLE)
    return scratch.table(of_label, "toxic-sample")


def _features(sample: DataFrame, voters: Voters) -> tuple[np.ndarray, ...]:
    """label, n, (doc, term, count) and lexicon counts and patterns of the sample's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                terms = Terms(part.column(2))
                doc, term, count, lexicons = voters.counted(terms)
                ends = np.searchsorted(doc, np.arange(terms.texts + 1))
                blob = [np.stack([term[a:b], count[a:b]]).astype("<i8").tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(terms.n.astype(np.int64)), pa.array(blob, pa.binary()), pa.array([x.astype("<f8").tobytes() for x in lexicons], pa.binary()), pa.array([x.astype(np.uint8).tobytes() for x in terms.patterns()], pa.binary())],
                    names=["doc_id", "label", "n", "terms", "lexicons", "patterns"],
                )

    rows = sorted(map(tuple, sample.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, label int, n long, terms binary, lexicons binary, patterns binary").collect()))
    cells = [np.frombuffer(r[3], "<i8").reshape(2, -1) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [c.shape[1] for c in cells])
    term, count = np.concatenate([*cells, np.empty((2, 0), np.int64)], 1)
    n = np.array([r[2] for r in rows], np.int64)
    return np.array([r[1] for r in rows], np.int64), n, doc, term, count, np.array([np.frombuffer(r[4], "<f8") for r in rows]), np.array([np.frombuffer(r[5], np.uint8) for r in rows]).astype(bool)


def _moments(own: DataFrame, voters: Voters) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of texts that are not held out, and the first and second moments of their votes."""
    size = 2 * VOTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                terms = Terms(part.column(0))
                f = indicators(voters.votes(terms.n, voters.counted(terms)[3], terms.patterns()))
                f = np.concatenate([f, np.ones((len(f), 1))], 1)
                total += f.T @ f
        at = np.argwhere(total > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(total[at[:, 0], at[:, 1]].astype(np.int64))], names=["i", "j", "k"])

    summed = own.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, "i int, j int, k long").groupBy("i", "j").agg(F.sum("k"))
    m = np.zeros((size + 1, size + 1))
    for i, j, k in summed.collect():  # at most as many rows as the matrix has cells
        m[i, j] = k
    n = max(1.0, m[size, size])
    return int(m[size, size]), m[size, :size] / n, m[:size, :size] / n


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer | float:
    """A scorer from the labels that are not held out; a number where there is nothing to tell apart."""
    own = _own(docs, id_col, text_col)
    given = labels.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(label_col)).cast("int").alias("label"))
    given = given.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id")))
    counts = {r["label"]: r["k"] for r in given.groupBy("label").agg(F.count("*").alias("k")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    share = counts[1] / (counts[0] + counts[1])
    sample = _sampled(own, given)
    there = {r["label"]: r["k"] for r in sample.groupBy("label").agg(F.count("*").alias("k")).collect()}
    if not there.get(0) or not there.get(1):
        return share
    voters = Voters(*_mined(sample, there[1], there[0]))
    label, n, doc, term, count, lexicons, patterns = _features(sample, voters)
    # voters are judged without the terms a text made; the classifier, which has a penalty, learns from all of them
    unseen = voters.without_own(label, doc, term, count, lexicons)
    voters.calibrate(n, unseen, label)
    votes = voters.votes(n, unseen, patterns)
    _, mean, second = _moments(own, voters)
    # the sample has half of each label: rows are weighed back to the labels' shares
    weight = np.where(label == 1, share / there[1], (1 - share) / there[0])
    with_label = (indicators(votes) * (weight * (label - share))[:, None]).sum(0)
    model = LabelModel(mean, second, with_label, share)
    model.calibrate(votes, label, weight)
    target = model.posterior(votes, label)
    linear = Linear(len(voters.names)).fit(n, doc, term, count, lexicons, target, weight)
    return Scorer(voters, model, linear)


def score(docs: DataFrame, scorer: Scorer | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                out = np.full(part.num_rows, scorer) if isinstance(scorer, float) else scorer.scores(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out)], names=["doc_id", "score"])

    return _own(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
