"""Row-level access and masking: who may see which document, and which of its columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

VISITOR = "-"
MODES = ("all", "mine", "public")


@dataclass(frozen=True)
class Scope:
    """What a reader may see; no user means no restriction."""

    user_id: str | None
    mode: str = "all"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")


def scope_for(user_id: str | None, is_admin: bool, mode: str = "all") -> Scope:
    """A visitor owns nothing and sees what is public; an administrator is unrestricted."""
    if user_id is None:
        return Scope(VISITOR, "public" if mode == "mine" else mode)
    return Scope(None, mode) if is_admin else Scope(user_id, mode)


def readable(scope: Scope | None, owner: str = "owner_id", visibility: str = "visibility") -> Column:
    """The access predicate, to stand beside the scan so that it is pushed down."""
    if scope is None or scope.user_id is None:
        return F.lit(True)
    mine, public = F.col(owner) == scope.user_id, F.col(visibility) == "public"
    return {"all": mine | public, "mine": mine, "public": public}[scope.mode]


def matching(filters: dict[str, str | None]) -> Column:
    """Equality on each filter that is given."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in filters.items() if v is not None], F.lit(True))


def user_filters(filters: dict[str, str | None], is_admin: bool) -> dict[str, str | None]:
    """Owner and visibility filters are for administrators only and silently dropped for others."""
    return filters if is_admin else {k: v for k, v in filters.items() if k not in ("owner_id", "visibility")}


def searchable(kind: str = "kind") -> Column:
    """Everything but bare headings; a missing kind passes."""
    return ~F.col(kind).eqNullSafe(F.lit("heading"))


def masked_hits(hits: DataFrame, user_id: str | None, is_admin: bool, users: DataFrame) -> DataFrame:
    """Hits with is_mine computed first, then owner and path hidden from those who may not see them."""
    mine = F.coalesce(F.col("owner_id") == F.lit(user_id), F.lit(False))
    named = hits.join(users.select(F.col("user_id").alias("owner_id"), F.col("username").alias("owner_name")), "owner_id", "left")
    shown = named.withColumn("is_mine", mine)
    if is_admin:
        return shown
    return shown.withColumns({"filepath": F.when(F.col("is_mine"), F.col("filepath")).otherwise(""), "owner_id": F.lit(None).cast("string"), "owner_name": F.lit(None).cast("string")})


def masked_documents(documents: DataFrame, user_id: str, is_admin: bool) -> DataFrame:
    """The document list: path and hash only for one's own, owner only for administrators."""
    mine = F.col("owner_id") == user_id
    see = mine | F.lit(is_admin)
    return documents.withColumns(
        {
            "is_mine": mine,
            "can_manage": see,
            "filepath": F.when(see, F.col("filepath")).otherwise(""),
            "file_hash": F.when(see, F.col("file_hash")).otherwise(""),
            "owner_id": F.when(F.lit(is_admin), F.col("owner_id")),
        }
    )


def masked_jobs(jobs: DataFrame, user_id: str | None, is_admin: bool) -> DataFrame:
    """Runs as a reader sees them: another's run shows that it runs and how far it is, not whose files or failures."""
    mine = F.lit(is_admin) | F.coalesce(F.col("started_by") == F.lit(user_id), F.lit(False))
    hidden = {c: F.when(mine, F.col(c)) for c in ("directory", "current_file", "started_by", "failures") if c in jobs.columns}
    return jobs.withColumn("_mine", mine).withColumns(hidden).withColumnRenamed("_mine", "is_mine")


def valid_password(password: Column, least: int = 8, most: int = 128) -> Column:
    return F.length(password).between(least, most)


def split_request(requested: DataFrame, allowed: DataFrame, key: str = "document_id") -> DataFrame:
    """Requested ids, each once in order of first mention, as updated or unknown."""
    first = requested.groupBy(key).agg(F.min("position").alias("position"))
    known = allowed.select(key).distinct().withColumn("known", F.lit(True))
    return first.join(known, key, "left").select(key, "position", F.when(F.col("known"), "updated").otherwise("unknown").alias("outcome"))


def valid_username(name: Column, reserved: tuple[str, ...] = ("admin", "library", "system")) -> Column:
    key = F.lower(F.trim(name))
    return key.rlike(r"^[a-z0-9][a-z0-9._-]{2,31}$") & ~key.isin(*reserved)


def check_search(query: str, top_k: int | None, default: int = 10, most: int = 100) -> tuple[str, int]:
    """A search request's text and count, or a ValueError."""
    text = query.strip()
    if not text or len(query) > 2000:
        raise ValueError("the query must have 1 to 2000 characters")
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be at least 1")
    return text, min(top_k or default, most)


def checked_search(query: Column, top_k: Column, default: int = 10, most: int = 100) -> Column:
    """A table's search requests, (query, top_k, error): what check_search returns, or which part it refuses."""
    text = T.strip(query)
    error = F.when((F.coalesce(text, F.lit("")) == "") | (F.length(query) > 2000), "query").when(top_k < 1, "top_k")
    count = F.least(F.coalesce(top_k, F.lit(default)), F.lit(most))
    return F.struct(F.when(error.isNull(), text).alias("query"), F.when(error.isNull(), count).alias("top_k"), error.alias("error"))


def published(documents: DataFrame, publishers: DataFrame, users: DataFrame) -> DataFrame:
    """Documents with who made them public and both names; null where there is no such user any more."""
    names = users.select("user_id", "username")
    made = documents.join(publishers.select("document_id", "publisher"), "document_id", "left")
    made = made.join(names.select(F.col("user_id").alias("publisher"), F.col("username").alias("publisher_name")), "publisher", "left")
    return made.join(names.select(F.col("user_id").alias("owner_id"), F.col("username").alias("owner_name")), "owner_id", "left")
