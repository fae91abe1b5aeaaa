"""The models that a library works with, as parts: each is given by its user and replaced in tests.

A part that needs a model of its own (weights, a vocabulary) is a function that loads it; a task
loads it once, at its first batch, and hands it slices of a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions.ids import hash_embedding, overlap_score
from ..functions.text import estimate_tokens
from ..sources import shared
from . import rag
from .access import Scope, readable
from .chunking import CharTokens

SLICE = 256
Embed = Callable[[list[str]], Any]


class PieceTokens:
    """A SentencePiece model's tokens, for passages: counts, and texts cut in so many tokens each.

    Counts are kept for the latest texts, as a passage's sentences are counted more than once.
    """

    def __init__(self, path: str):
        self.model = _pieces(path)
        self.count = lru_cache(1 << 14)(self._count)

    def _count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def split(self, text: str, most: int) -> list[str]:
        """The text in parts of at most `most` tokens, cut where the model cuts; the parts joined are the text."""
        raw, found = text.encode(), self.model.encode(text, return_type="proto").pieces
        # a character that the model has as bytes is several pieces from one place on: a cut is where a piece begins past the one before
        parts, start, held = [], 0, 0
        for k, piece in enumerate(found):
            if held >= most and piece.begin > start and found[k - 1].begin < piece.begin:
                parts.append(raw[start : piece.begin].decode())
                start, held = piece.begin, 0
            held += 1
        return [*parts, raw[start:].decode()] if start < len(raw) else parts


@lru_cache(2)
def _pieces(path: str):
    """The model of a path, once a worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_count(text: Column, path: str) -> Column:
    """How many tokens a SentencePiece model has for a text; null for null. The path is one that every executor can read."""

    def counted(texts: pa.Array) -> pa.Array:
        model = _pieces(path)
        slices = (texts.slice(a, SLICE).to_pylist() for a in range(0, len(texts), SLICE))
        return pa.array([None if t is None else len(model.encode(t, num_threads=1)) for own in slices for t in own], pa.int64())

    return F.arrow_udf(counted, "long")(text)


def embedded(rows: DataFrame, load: Callable[[], Embed], dimension: int, text_col: str = "text", size: int = SLICE, into: str = "embedding") -> DataFrame:
    """The rows with a vector of unit length for each text, null for a null one.

    load() gives a function from a list of texts to as many vectors; it is called once a task and
    gets at most `size` texts at a time. Another number of vectors, or of places in one, is an
    error. A column named as `into` is replaced.
    """
    kept = rows.drop(into)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = None
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                own = batch.slice(a, size)
                texts = own.column(at).to_pylist()
                given = [t for t in texts if t is not None]
                flat = np.zeros((0, dimension), np.float32)
                if given:
                    embed = embed or load()
                    flat = np.asarray(embed(given), np.float32)
                    if flat.shape != (len(given), dimension):
                        raise ValueError(f"{len(given)} texts of {dimension} places each, but vectors of the shape {flat.shape}")
                    flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
                found = iter(flat.tolist())
                vectors = pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*own.columns, vectors], names=names)

    # columns go by number on the way, as mapInArrow does not take every name
    names = [f"c{k}" for k in range(len(kept.columns) + 1)]
    kinds = StructType([StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields)]).add(names[-1], ArrayType(FloatType()))
    return kept.toDF(*names[:-1]).mapInArrow(run, kinds).toDF(*kept.columns, into)


def checked_question(question: Column) -> Column:
    """A question to embed, as it stands; an error where there is nothing in it."""
    return F.when(F.coalesce(F.trim(question), F.lit("")) == "", F.raise_error(F.lit("nothing to search for")).cast("string")).otherwise(question)


@dataclass(frozen=True)
class Models:
    """What a library needs from models and from its users' rights; the defaults are stand-ins that need no model.

    tokens makes a counter for passages (on an executor); estimate is its estimate as an expression; load makes a
    function from texts to vectors of `dimension` places, None: hashes stand in; relevance is a score of (question,
    text), null where the model fails; answer takes the prompt, None: there is no model; may_see gives the rows that
    a scope may see.
    """

    tokens: Callable[[], Any] = CharTokens
    estimate: Callable[[Column], Column] = estimate_tokens
    load: Callable[[], Embed] | None = None
    dimension: int = 64
    relevance: Callable[[Column, Column], Column] = overlap_score
    answer: Callable[[Column], Column] | None = None
    may_see: Callable[[Scope | None], Column] = readable

    def vectors(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        if self.load is not None:
            return embedded(rows, self.load, self.dimension, text_col)
        return rows.withColumn("embedding", F.when(F.col(text_col).isNotNull(), hash_embedding(F.col(text_col), self.dimension)).cast("array<float>"))

    def answers(self, questions: DataFrame, hits: DataFrame, scope: Scope | None = None, candidates: int = 20, least: float = 0.0, most: int = 6, budget: int = 3000, key: str = "ask_id") -> DataFrame:
        """(key, status, language, n_sources, answer): hits that the scope may see are scored, packed and put to the model, where there is one and there are sources."""
        seen = hits.where(self.may_see(scope)) if scope is not None else hits
        scored = rag.rerank_or_search(seen, candidates, self.relevance(F.col("question"), F.col("text")), key)
        # states and prompts both need them: scored once, a few rows a question
        sources = shared.written(rag.source_rows(rag.relevant(scored, least), most, budget, key), "sources")
        states = rag.answer_states(questions, sources, self.answer is not None, key)
        asked = states.join(questions.select(key, "question"), key)
        out = asked.join(rag.prompts(asked, sources, key), key, "left")
        said = F.lit(None).cast("string") if self.answer is None else F.when(F.col("status") == "generate", self.answer(F.col("message")))
        return out.select(key, "status", "language", "n_sources", said.alias("answer"))
