"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Every stage reads what the one before it kept, as a table, and returns the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm import decontaminate, jaccard_join, language, packing, scratch, secrets_scan
from lexmere.llm.carry import restored

#: a document goes when no language is as likely as this, or it holds no letter
LEAST_LANGUAGE = 0.35

ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.

    A null or empty text, and one without a letter, goes. A row without an id or of a
    repeated id is judged by its text like any other. A tie of languages decides for the
    first by name and refuses nothing. Without a labelled row all rows stay.
    """
    network = language.learn(docs)
    found = language.identify(docs, network, carry=True)
    if network is None:  # nothing was labelled: no language can be refused
        return restored(found, docs)
    return restored(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of linked documents: five words a shingle, a similarity of 0.8.

    A text without words has no links and stays. A row without an id stays. Of rows that
    repeat an id and a text one stays; a text of its own stays though its id's other text goes.
    """
    return jaccard_join.first_of_groups(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages they share with the benchmark; a text of which nothing is left goes.

    A null or empty text is as it was. Overlapping passages are cut as one. Repeated rows,
    and those without an id, are cut alike. An empty benchmark changes nothing.
    """
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    left = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return restored(left, docs, "clean")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark, one for a run of overlapping ones.

    A null text becomes an empty one. No row goes; repeated rows are changed alike.
    """
    found = secrets_scan.scan(docs, carry=True)
    return restored(found.withColumn("shown", secrets_scan.redacted(F.col("text"), F.col("found"))), docs, "shown")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: all tokens of all rows, once each.

    A null or empty text is its end id alone; repeated rows are packed as often as they stand there.
    """
    return packing.pack(docs)


STAGES = [
    ("language id", by_language),
    ("n-gram jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages stands a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name.replace(" ", "-"))
    return docs
