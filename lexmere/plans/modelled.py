"""Queries through the parts that stand for models: vectors in slices, answers, a vocabulary's tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import models
from . import derived as d
from .catalog import query, table
from .retrieval import _PACKED


def _signs():
    """A stand-in for a model: a text's characters, spaces and commas, and 1."""
    return lambda texts: np.array([[len(t), t.count(" "), t.count(","), 1.0] for t in texts])


@query("SELECT doc_id, length(text) AS characters, length(text) - length(replace(text, ' ', '')) AS spaces, length(text) - length(replace(text, ',', '')) AS commas FROM documents")
def vectors_in_slices(spark, sf):
    """What a vector of unit length still says: its places by the last one. A null text has no vector."""
    v = models.embedded(table(spark, sf, "documents").select("doc_id", "text"), _signs, 4)
    part = [F.round(F.col("embedding")[k].cast("double") / F.col("embedding")[3]).cast("long").alias(n) for k, n in enumerate(("characters", "spaces", "commas"))]
    return v.select("doc_id", *part)


@query(
    _PACKED
    + """SELECT q.ask_id, CAST(count(s.n) AS BIGINT) AS n_sources, CASE WHEN count(s.n) = 0 THEN 'not_found' ELSE 'generate' END AS status, any_value(s.filename) FILTER (WHERE s.n = 1) AS answer
    FROM questions q LEFT JOIN sources s ON s.ask_id = q.ask_id GROUP BY q.ask_id"""
)
def answers_by_models(spark, sf):
    """A stand-in for a model answers with the name of its first source's file."""
    given = models.Models(answer=lambda message: F.regexp_extract(message, r'<source id="1" file="([^"]*)"', 1))
    found = given.answers(d.questions(spark, sf), d.hits(spark, sf), candidates=6, least=0.5, most=3, budget=260)
    return found.select("ask_id", F.col("n_sources").cast("long").alias("n_sources"), "status", "answer")


@query()
def piece_counts(spark, sf):
    """Tokens of a public SentencePiece vocabulary."""
    import public_tokenizers

    own = table(spark, sf, "documents")
    return own.select("doc_id", models.piece_count(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("pieces"))
