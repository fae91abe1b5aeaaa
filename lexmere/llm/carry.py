"""Carrying a table's columns through an operator that works on (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(column: str) -> str:
    """A column's name as an expression reads it, whatever signs it holds."""
    return "`" + column.replace("`", "``") + "`"


def with_rest(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(doc_id, text, rest) with every other column inside rest, and rest's type."""
    others = [F.col(named(c)) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(None).cast("int").alias("none")]
    out = docs.select(F.col(named(id_col)).cast("long").alias("doc_id"), F.col(named(text_col)).cast("string").alias("text"), F.struct(*others).alias("rest"))
    return out, f"struct<{out.schema['rest'].dataType.toDDL()}>"


def restored(carried: DataFrame, like: DataFrame, text: str = "text") -> DataFrame:
    """The columns of the documents table `like`, with the text of another column and n_chars to match."""
    columns = []
    for name, kind in like.dtypes:
        if name == "doc_id":
            columns.append(F.col("doc_id"))
        elif name == "text":
            columns.append(F.col(text).alias("text"))
        elif name == "n_chars":
            columns.append(F.coalesce(F.length(text), F.lit(0)).cast(kind).alias("n_chars"))
        else:
            columns.append(F.col("rest").getField(name).alias(name))
    return carried.select(*columns)
