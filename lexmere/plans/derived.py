"""Tables derived from the given ones by fixed rules, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from .catalog import table


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest row for each document."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    owner = F.concat(F.lit("u"), (F.col("doc_id") % 4).cast("string"))
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".docx").otherwise(".pdf"))
    digest = ids.content_hash(F.col("text"))
    return d.select(
        "doc_id",
        ids.document_id(owner, digest).alias("document_id"),
        name.alias("filename"),
        F.concat(F.lit("/d/users/"), owner, F.lit("/"), name).alias("filepath"),
        digest.alias("file_hash"),
        F.col("lang").alias("language"),
        F.ceil(F.col("n_chars") / 2000).cast("int").alias("pages"),
        (F.floor(F.col("n_chars") / 300) + 1).cast("int").alias("chunks"),
        F.when(F.col("n_chars") < 20, "unsupported").when(F.col("doc_id") % 17 == 0, "failed").otherwise("indexed").alias("status"),
        owner.alias("owner_id"),
        F.when(F.col("doc_id") % 3 == 0, "public").otherwise("private").alias("visibility"),
        "n_chars",
    )


MANIFEST = """manifest AS (
    SELECT *, CASE WHEN n_chars < 20 THEN 'unsupported' WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'indexed' END AS status,
        '/d/users/' || owner_id || '/' || filename AS filepath, sha256('user:' || owner_id || ':' || file_hash) AS document_id
    FROM (SELECT doc_id, n_chars, lang AS language, 'u' || (doc_id % 4) AS owner_id, sha256(text) AS file_hash,
        doc_id || CASE WHEN doc_id % 5 = 0 THEN '.docx' ELSE '.pdf' END AS filename,
        CAST(ceil(n_chars / 2000) AS INTEGER) AS pages, CAST(n_chars // 300 + 1 AS INTEGER) AS chunks,
        CASE WHEN doc_id % 3 = 0 THEN 'public' ELSE 'private' END AS visibility FROM documents WHERE doc_id IS NOT NULL))"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage for each vector: its label is the document."""
    e = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    index = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    page = (F.col("vec_id") % 9 + 1).cast("int")
    return e.select(
        "vec_id",
        F.col("label").cast("string").alias("document_id"),
        index.cast("int").alias("chunk_index"),
        F.when(F.col("vec_id") % 11 == 0, "heading").when(F.col("vec_id") % 13 == 0, F.lit(None)).otherwise("text").alias("kind"),
        F.concat(F.lit("src"), (F.col("label") % 5).cast("string")).alias("owner_id"),
        F.when(F.col("label") % 3 == 0, "public").otherwise("private").alias("visibility"),
        F.when(F.col("label") % 2 == 0, "en").otherwise("de").alias("language"),
        F.concat(F.lit("f"), F.col("label").cast("string"), F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("/d/f"), F.col("label").cast("string"), F.lit(".pdf")).alias("filepath"),
        page.alias("page_start"),
        (page + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)).cast("int").alias("page_end"),
        (F.col("vec_id") % 200 + 20).cast("int").alias("token_count"),
        "embedding",
    )


PASSAGES = """passages AS (
    SELECT vec_id, CAST(label AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS chunk_index,
        CASE WHEN vec_id % 11 = 0 THEN 'heading' WHEN vec_id % 13 = 0 THEN NULL ELSE 'text' END AS kind,
        'src' || (label % 5) AS owner_id, CASE WHEN label % 3 = 0 THEN 'public' ELSE 'private' END AS visibility,
        CASE WHEN label % 2 = 0 THEN 'en' ELSE 'de' END AS language, 'f' || label || '.pdf' AS filename, '/d/f' || label || '.pdf' AS filepath,
        CAST(vec_id % 9 + 1 AS INTEGER) AS page_start, CAST(vec_id % 9 + 1 + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS page_end,
        CAST(vec_id % 200 + 20 AS INTEGER) AS token_count, embedding, label
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"""
#: inner product of two float lists in doubles
DOT = "round(list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user for each nation, every fifth an administrator, the later ones older."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    created = F.concat(F.lit("2024-01-"), F.lpad((28 - key).cast("string"), 2, "0"))
    return n.select(F.concat(F.lit("u"), key.cast("string")).alias("user_id"), F.lower("n_name").alias("username"), (key % 5 == 0).alias("is_admin"), created.alias("created_on"))


USERS = "users AS (SELECT 'u' || n_nationkey AS user_id, lower(n_name) AS username, n_nationkey % 5 = 0 AS is_admin, '2024-01-' || lpad(CAST(28 - n_nationkey AS VARCHAR), 2, '0') AS created_on FROM nation)"


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer as three levels of folders."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return (
        r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("folder_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
        .unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("name")))
        .unionByName(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("folder_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.col("c_name").alias("name")))
    )


FOLDERS = """folders AS (
    SELECT 'r' || r_regionkey AS folder_id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, in its nation's folder; every seventh at the root."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_id"), F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("folder_id"), F.col("s_name").alias("name"))


FILES = "files AS (SELECT 's' || s_suppkey AS file_id, CASE WHEN s_suppkey % 7 <> 0 THEN 'n' || s_nationkey END AS folder_id, s_name AS name FROM supplier)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each conversation: its first user turn."""
    c = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).select(F.col("conv_id").alias("ask_id"), "question")


QUESTIONS = "questions AS (SELECT conv_id AS ask_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's hits: the benchmark texts whose id leaves the same remainder, in an order that depends on both ids."""
    b, asked = table(spark, sf_dir, "benchmark"), questions(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("ask_id").orderBy(F.expr("(item_id * 7 + ask_id) % 41"), "item_id"))
    # ranked by ids alone: texts join afterwards, so that no sort holds them
    met = asked.select("ask_id", F.expr("ask_id % 4").alias("part")).join(b.select("item_id", F.expr("item_id % 4").alias("part")), "part")
    return (
        met.select("ask_id", "item_id", rank.alias("rank")).join(asked, "ask_id").join(b, "item_id")
        .select("ask_id", "question", "rank", F.col("item_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), "text",
                F.concat(F.lit("b"), F.col("item_id").cast("string"), F.lit(".docx")).alias("filename"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit(None).cast("string").alias("heading"))
    )


HITS = """hits AS (
    SELECT ask_id, question, row_number() OVER (PARTITION BY ask_id ORDER BY (item_id * 7 + ask_id) % 41, item_id) AS rank,
        CAST(item_id AS VARCHAR) AS document_id, 0 AS chunk_index, text, 'b' || item_id || '.docx' AS filename
    FROM questions JOIN benchmark ON item_id % 4 = ask_id % 4)"""


def spoken(text: str, n: str) -> str:
    """SQL, for both engines, of a text in one of several scripts by a number: the text itself, or all of it behind a made sentence."""
    kinds = [text, f"concat('이 문서는 필터 교체를 다룹니다 ', {text})", f"concat('更换滤芯之前请关闭电源 ', {text})", f"concat('這個濾芯請更換 ', {text})", f"concat('フィルターを交換する ', {text})", f"concat('фильтр меняют раз в год ', {text})", f"concat('필터 교체 更换滤芯 ', {text})", f"concat('12 + 3 ', {text})"]
    return f"CASE {n} % {len(kinds)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(kinds)) + " END"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + "\n"
