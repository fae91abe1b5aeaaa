"""Directory scans: discovery, candidate rules, content checks, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from ..functions.text import file_type

SUFFIXES = ("pdf", "docx")
MEDIA_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
MOST_BYTES = 200 * 1024 * 1024
# fixed values: the first bytes of the formats
PDF_MAGIC, ZIP_MAGIC, OLE_MAGIC = "255044462D", "504B0304", "D0CF11E0A1B11AE1"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_candidate(path: Column) -> Column:
    """A supported suffix, no hidden or lock file, nothing below an archive's metadata folder."""
    name = file_name(path)
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*SUFFIXES) & ~name.rlike(r"^(\.|~\$)") & ~F.concat(F.lit("/"), path).contains("/__MACOSX/")


def discover(spark: SparkSession, root: str, below: str | None = None, without: str | None = None) -> DataFrame:
    """(path, modified_at, length, content) of a tree's candidate files; content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = found.select(F.regexp_replace("path", r"^file:(//)?", "").alias("path"), F.col("modificationTime").alias("modified_at"), "length", "content")
    kept = found.where(is_candidate(F.col("path")))
    if below:
        kept = kept.where(F.startswith(F.col("path"), F.lit(below.rstrip("/") + "/")))
    return kept.where(~F.startswith(F.col("path"), F.lit(without.rstrip("/") + "/"))) if without else kept


def listed(files: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of an explicit list, and the requested paths that are absent."""
    asked = requested.select("path").distinct()
    return files.join(asked, "path", "left_semi"), asked.join(files.select("path"), "path", "left_anti")


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumns({"file_hash": content_hash(F.col("content")), "filename": file_name(F.col("path")), "file_type": file_type(file_name(F.col("path")))})


def media_type(suffix: Column) -> Column:
    out = F.lit("application/octet-stream")
    for k, v in MEDIA_TYPES.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def reject_reason(files: DataFrame) -> Column:
    """Why an upload is refused, by its suffix, size and first bytes; null if it is not."""
    del files
    head, kind = F.hex(F.substring("content", 1, 8)), file_type(F.col("filename"))
    return (
        F.when(F.col("length") > MOST_BYTES, "too large")
        .when(F.col("length") == 0, "empty")
        .when((kind == "pdf") & ~F.startswith(head, F.lit(PDF_MAGIC)), "not a PDF")
        .when((kind == "docx") & F.startswith(head, F.lit(OLE_MAGIC)), "an old or encrypted Word file")
        .when((kind == "docx") & ~F.startswith(head, F.lit(ZIP_MAGIC)), "not a Word file")
    )


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of an evaluation set in JSON, one row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
