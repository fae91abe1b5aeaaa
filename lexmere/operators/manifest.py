"""The document manifest: identity, duplicates, incremental runs, table writes as whole snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import LIBRARY, document_id, within
from ..sources import shared

TERMINAL = ("indexed", "unsupported")


def known_paths(documents: DataFrame) -> DataFrame:
    """(path, document_id, filename): the primary and alternate paths of each record."""
    return documents.select(F.explode(F.array_union(F.array("filepath"), F.coalesce("alt_filepaths", F.array().cast("array<string>")))).alias("path"), "document_id", "filename")


def by_path(documents: DataFrame) -> DataFrame:
    """One record for each known path: the first by file name."""
    return known_paths(documents).groupBy("path").agg(F.min_by("document_id", F.struct("filename", "document_id")).alias("document_id"))


def exact_duplicates(files: DataFrame) -> DataFrame:
    """One row a document_id: the least path is primary, the others are its sorted alternates."""
    grouped = files.groupBy("document_id").agg(F.min("filepath").alias("filepath"), F.array_sort(F.collect_set("filepath")).alias("paths"))
    return grouped.select("document_id", "filepath", F.slice("paths", 2, F.greatest(F.size("paths") - 1, F.lit(0))).alias("alt_filepaths"))


def pending(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files to process: unknown, failed before, or all when forced. Done before any costly step."""
    if force:
        return files
    done = manifest.where(F.col("status").isin(*TERMINAL)).select("document_id")
    return files.join(done, "document_id", "left_anti")


def vanished(manifest: DataFrame, seen: DataFrame, roots: list[str], unreadable: list[str] | None = None) -> DataFrame:
    """Records whose content was not met in a whole-tree run, under its roots and outside unreadable ones."""
    in_scope = reduce(lambda a, b: a | b, [within(F.col("filepath"), F.lit(r)) for r in roots], F.lit(False))
    hidden = reduce(lambda a, b: a | b, [within(F.col("filepath"), F.lit(r)) for r in unreadable or []], F.lit(False))
    return manifest.where(in_scope & ~hidden).join(seen.select("document_id").distinct(), "document_id", "left_anti")


def sync(rows: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change): placements that lost their file, and files without a placement."""
    both = rows.select("path", F.lit(1).alias("row")).join(disk.select("path", F.lit(1).alias("file")), "path", "full_outer")
    change = F.when(F.col("file").isNull(), "dropped").when(F.col("row").isNull(), "added").otherwise("kept")
    return both.select("path", change.alias("change"))


def carried_public(documents: DataFrame, public: DataFrame) -> DataFrame:
    """Documents that take the public flag from another version at the same path."""
    old = documents.join(public.select("document_id"), "document_id", "left_semi").select(F.col("filepath").alias("path"), F.col("document_id").alias("old_id"))
    return documents.join(old, (F.col("filepath") == F.col("path")) & (F.col("document_id") != F.col("old_id")), "left_semi")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row a key, the last by version: an upsert read back."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the fresh rows in place of those of equal keys; the caller commits the snapshot."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def replace_documents(passages: DataFrame, fresh: DataFrame) -> DataFrame:
    """Passages with the documents in fresh written anew: none of a document's old passages survives."""
    return passages.join(fresh.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def set_where(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """A conditional update: new values where the condition holds."""
    return table.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in changes.items()})


def rekey(passages: DataFrame, old: str, new: str, owner: str, path: str, name: str) -> DataFrame:
    """A document's passages under another id, owner and path; vectors stay."""
    return set_where(passages, F.col("document_id") == old, {"owner_id": F.lit(owner), "filepath": F.lit(path), "filename": F.lit(name), "document_id": F.lit(new)})


def with_owner_defaults(table: DataFrame) -> DataFrame:
    """Rows without an owner belong to the library and are private."""
    missing = F.col("owner_id").isNull() | (F.col("owner_id") == "")
    return table.withColumns({"visibility": F.when(missing, F.coalesce("visibility", F.lit("private"))).otherwise(F.col("visibility")), "owner_id": F.when(missing, F.lit(LIBRARY)).otherwise(F.col("owner_id"))})


def add_missing_columns(table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return table.withColumns({k: v for k, v in defaults.items() if k not in table.columns})


def rebuild(passages: DataFrame) -> DataFrame:
    """The manifest from the passages: counts, last page, and each document's first passage's values."""
    first = {c: F.min_by(c, "chunk_index").alias(c) for c in ("filename", "filepath", "language")}
    out = passages.where("document_id IS NOT NULL AND document_id <> ''").groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.max("page_end").alias("pages"), *first.values(), F.coalesce(F.min_by("owner_id", "chunk_index"), F.lit(LIBRARY)).alias("owner_id"), F.coalesce(F.min_by("visibility", "chunk_index"), F.lit("private")).alias("visibility")
    )
    return out


def owner_counts(documents: DataFrame) -> DataFrame:
    own = documents.where("status = 'indexed'")
    return own.groupBy("owner_id").agg(F.count("*").alias("documents"), F.count_if(F.col("visibility") == "public").alias("public_documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("passages"))


def totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("passages"))


def unique_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Free names for (position, name): "stem (2).ext" and on, past those taken."""

    def parts(name: Column | str) -> list[Column]:
        return [F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", k) for k in (1, 2)]

    turn = F.row_number().over(Window.partitionBy("name").orderBy("position")).cast("long")
    asked = wanted.select("position", "name", turn.alias("turn"), F.lit(0).alias("taken"))
    # an existing name takes number 1 of itself, and "stem (k).ext" number k of "stem.ext"
    stem, ext = parts("name")
    base, k = (F.regexp_extract(stem, r"^(.*) \(([1-9][0-9]*)\)$", j) for j in (1, 2))
    numbered = existing.select(F.concat(base, ext).alias("name"), k.try_cast("long").alias("k")).where("k >= 2")
    numbers = existing.where("name IS NOT NULL").select("name", F.lit(1).cast("long").alias("k")).unionByName(numbered).distinct()
    # the turns after k less the numbers taken up to k lie beyond it
    after = F.col("k") - F.row_number().over(Window.partitionBy("name").orderBy("k"))
    both = asked.unionByName(numbers.select("name", after.alias("turn"), F.lit(1).alias("taken")), allowMissingColumns=True)
    before = F.sum("taken").over(Window.partitionBy("name").orderBy("turn", "taken").rowsBetween(Window.unboundedPreceding, 0))
    given = both.withColumn("k", F.col("turn") + before).where("taken = 0")
    option = F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("k").cast("string"), F.lit(")"), ext))
    return given.select("position", "name", option.alias("given"))


def merge_requests(requests: DataFrame) -> DataFrame:
    """Queued runs of one kind (scope, directory, force) as one; a run of everything absorbs lists of paths."""
    whole = F.bool_or(F.col("paths").isNull())
    # each path once, where it was first asked for: paths are made distinct before they are gathered
    first = requests.select("scope", "directory", "force", "position", F.posexplode_outer("paths").alias("_n", "_path")).where("_path IS NOT NULL")
    first = first.groupBy("scope", "directory", "force", "_path").agg(F.min(F.struct("position", "_n")).alias("_at"))
    paths = first.groupBy("scope", "directory", "force").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_path"))), lambda x: x["_path"]).alias("_paths"))
    kinds = requests.groupBy("scope", "directory", "force").agg(F.min("position").alias("position"), whole.alias("_whole"))
    joined = kinds.join(paths, ["scope", "directory", "force"], "left")
    listed = F.when(F.col("_whole"), F.lit(None).cast("array<string>")).otherwise(F.coalesce("_paths", F.array().cast("array<string>")))
    return joined.select("scope", "directory", "force", "position", listed.alias("paths"))


def forget_path(documents: DataFrame, path: str) -> DataFrame:
    """Records without one of their paths: the first alternate moves up; a record without a path goes."""
    left = F.array_remove(F.array_union(F.array("filepath"), F.col("alt_filepaths")), path)
    return documents.withColumn("_left", left).where(F.size("_left") > 0).withColumns({"filepath": F.element_at("_left", 1), "alt_filepaths": F.slice("_left", 2, F.greatest(F.size("_left") - 1, F.lit(0)))}).drop("_left")


def with_paths(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Records that files (document_id, path) bring new paths to, with these among their alternates."""
    paths = found.groupBy("document_id").agg(F.array_sort(F.collect_set("path")).alias("_found"))
    alternates = F.coalesce("alt_filepaths", F.array().cast("array<string>"))
    added = F.array_except("_found", F.array_union(F.array("filepath"), alternates))
    joined = documents.join(paths, "document_id").withColumn("_added", added).where(F.size("_added") > 0)
    return joined.withColumn("alt_filepaths", F.concat(alternates, F.col("_added"))).drop("_found", "_added")


def present(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Records with only those of their paths that a listing (path) has; those without one go. The order of paths stays."""
    every = F.array_union(F.array("filepath"), F.coalesce("alt_filepaths", F.array().cast("array<string>")))
    placed = documents.select("document_id", F.posexplode(every).alias("_n", "path")).join(listing.select("path").distinct(), "path", "left_semi")
    left = placed.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path"))), lambda x: x["path"]).alias("_left"))
    kept = documents.join(left, "document_id").withColumns({"filepath": F.element_at("_left", 1), "alt_filepaths": F.slice("_left", 2, F.greatest(F.size("_left") - 1, F.lit(0)))})
    return kept.drop("_left").select(*documents.columns)


def relocated(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, old, new): documents whose first path changed between two states of the manifest."""
    old = before.select("document_id", F.col("filepath").alias("old"))
    return old.join(after.select("document_id", F.col("filepath").alias("new")), "document_id").where("old <> new")


def adopted(documents: DataFrame, passages: DataFrame, old_owner: str, new_owner: str) -> tuple[DataFrame, DataFrame]:
    """Documents of one owner as another's: under the new owner's ids, private, and merged where that owner has the content.

    Returns documents and passages. A document that the new owner has keeps its passages
    and takes the other's paths as alternates; the other's passages go. All others are
    re-keyed and keep their vectors.
    """
    moving = F.col("owner_id") == old_owner
    target = F.when(moving, document_id(F.lit(new_owner), F.col("file_hash"))).otherwise(F.col("document_id"))
    named = documents.withColumn("_target", target)
    every = F.array_union(F.array("filepath"), F.coalesce("alt_filepaths", F.array().cast("array<string>")))
    paths = named.select("_target", moving.alias("_moving"), F.posexplode(every).alias("_n", "_path"))
    merged = paths.groupBy("_target").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_moving", "_n", "_path"))), lambda x: x["_path"])).alias("_paths"))
    order = Window.partitionBy("_target").orderBy(moving, "document_id")
    first = named.withColumn("_k", F.row_number().over(order)).where("_k = 1").join(merged, "_target")
    changed = {
        "document_id": F.col("_target"),
        "visibility": F.when(moving, "private").otherwise(F.col("visibility")),
        "owner_id": F.when(moving, new_owner).otherwise(F.col("owner_id")),
        "filepath": F.element_at("_paths", 1),
        "alt_filepaths": F.slice("_paths", 2, F.greatest(F.size("_paths") - 1, F.lit(0))),
    }
    kept = first.select(*[changed.get(c, F.col(c)).alias(c) for c in documents.columns])
    winners = first.select("document_id", F.col("_target"))
    rows = passages.join(winners, "document_id").withColumn("document_id", F.col("_target")).drop("_target")
    mine = F.col("owner_id") == old_owner
    return kept, rows.withColumns({"visibility": F.when(mine, "private").otherwise(F.col("visibility")), "owner_id": F.when(mine, new_owner).otherwise(F.col("owner_id"))}).select(*passages.columns)


def file_states(files: DataFrame, manifest_paths: DataFrame, running: DataFrame, queued: DataFrame) -> DataFrame:
    """A file's state: processing, queued, its record's status, or not_indexed, in this order."""
    joined = (
        files.join(running.select("path", F.lit(True).alias("is_running")), "path", "left")
        .join(queued.select("path", F.lit(True).alias("is_queued")), "path", "left")
        .join(manifest_paths.select("path", "status"), "path", "left")
    )
    state = F.when(F.col("is_running"), "processing").when(F.col("is_queued"), "queued").otherwise(F.coalesce("status", F.lit("not_indexed")))
    return joined.select("path", state.alias("state"))


def kept_failures(failures: DataFrame, run: str = "run", place: str = "place", most: int = 50) -> DataFrame:
    """The first failures of each run, as its record keeps them."""
    order = Window.partitionBy(run).orderBy(place)
    return failures.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def panel(files: DataFrame) -> DataFrame:
    """How many files of an upload panel wait, are worked on, are done and failed, by their state."""
    state = F.col("state")
    return files.agg(
        F.count_if(state.isin("queued", "waiting", "not_indexed")).alias("waiting"), F.count_if(state == "processing").alias("processing"),
        F.count_if(state.isin("indexed", "skipped")).alias("done"), F.count_if(state.isin("failed", "unsupported")).alias("failed"),
    )


def suggestions(searches: DataFrame, typed: str, most: int = 8) -> DataFrame:
    """Earlier searches that hold the typed text and are not it, newest first."""
    own = F.lower(F.lit(typed.strip()))
    found = searches.where(F.lower("query").contains(own) & (F.lower("query") != own))
    return found.groupBy(F.lower("query").alias("_key")).agg(F.max_by("query", F.struct("ts", "event_id")).alias("query"), F.max(F.struct("ts", "event_id")).alias("_at")).orderBy(F.desc("_at")).limit(most).select("query")


def settled_uploads(rows: DataFrame, rejected: DataFrame, saved: DataFrame, key: str = "batch") -> DataFrame:
    """What became of each chosen file (place, name) of an upload: rejected with a reason, saved, or not saved.

    A rejection (name, reason, place) is used once, by the first row of its name; of several rejections of a
    name the last says why. The other rows take the saved files (place, name, file_id) in order, whatever their
    names; those left over were not saved.
    """
    last = rejected.groupBy(key, "name").agg(F.max_by("reason", "place").alias("reason"))
    nth = F.row_number().over(Window.partitionBy(key, "name").orderBy("place"))
    told = rows.withColumn("_nth", nth).join(last.withColumn("_nth", F.lit(1)), [key, "name", "_nth"], "left").drop("_nth")
    passed = F.when(F.col("reason").isNull(), F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy("place")))
    files = saved.select(key, F.row_number().over(Window.partitionBy(key).orderBy("place")).alias("_file"), F.col("name").alias("_name"), "file_id")
    joined = told.withColumn("_file", passed).join(files, [key, "_file"], "left")
    there = F.col("file_id").isNotNull()
    state = F.when(there, "waiting").otherwise("rejected")
    return joined.select(key, "place", F.when(there, F.col("_name")).otherwise(F.col("name")).alias("name"), state.alias("state"), F.when(~there, F.coalesce("reason", F.lit("not saved"))).alias("error"), "file_id")


def without_user(user_id: str, users: DataFrame, documents: DataFrame, passages: DataFrame, files: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after a user is deleted with all that is theirs, and (table, removed, left) of each.

    Documents and files go by owner, passages with their documents. The counts are of the same
    predicates, so they agree with the tables whatever else is written meanwhile.
    """
    own = {"users": F.col("user_id") == user_id, "documents": F.col("owner_id") == user_id, "passages": F.col("owner_id") == user_id, "files": F.col("owner_id") == user_id}
    tables = {"users": users, "documents": documents, "passages": passages, "files": files}
    kept = {name: df.where(~F.coalesce(own[name], F.lit(False))) for name, df in tables.items()}
    counts = [df.agg(F.count_if(F.coalesce(own[name], F.lit(False))).alias("removed"), F.count_if(~F.coalesce(own[name], F.lit(False))).alias("left")).select(F.lit(name).alias("table"), "removed", "left") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return kept, out


def preview(files: DataFrame, known: DataFrame, offset: int, limit: int) -> DataFrame:
    """A window of the pages of files extracted again (document_id, file_hash, pages), and whether the content is still the indexed one.

    hash_matches is null for a file that no record knows; total_pages counts all pages.
    """
    joined = files.alias("f").join(known.select("document_id", F.col("file_hash").alias("_known")), "document_id", "left")
    shown = F.slice("pages", offset + 1, limit)
    return joined.select("document_id", F.size("pages").alias("total_pages"), (F.col("file_hash") == F.col("_known")).alias("hash_matches"), shown.alias("shown"))


def settings(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Settings (key, value as JSON text) with each known key's default where it is missing or no JSON: key, kind, value."""
    spark = rows.sparkSession
    known = spark.createDataFrame(sorted(defaults.items()), "key string, _default string")
    parsed = F.coalesce(F.try_parse_json("value"), F.parse_json("_default"))
    return known.join(rows, "key", "left").select("key", F.schema_of_variant(parsed).alias("kind"), F.to_json(parsed).alias("value"))


def by_locale(column: str, collation: str = "UNICODE_CI") -> list[Column]:
    """Order as a reader's language has it, case aside; equal names by code point."""
    return [F.collate(F.col(column), collation), F.col(column)]


def numbered(rows: DataFrame, *order: Column | str, into: str = "place") -> DataFrame:
    """Rows with their place, from 1, in one order of them all; rows of equal keys in no fixed order.

    Ranges of the keys are sorted and numbered each in a task of its own; a table of how many rows each
    range has, one row a range, gives what stands before it. No task sees all rows.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # written once: a second reading must not cut other ranges
    kept = shared.written(placed, "numbered").withColumn("_range", F.shiftright("_at", 33))
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(before), "_range").withColumn(into, F.col("_before") + inside).drop("_range", "_at", "_before")


def settled(extracted: DataFrame, passages: DataFrame) -> DataFrame:
    """What came of each extracted document (document_id, status, error_message): indexed with its number of passages, or unsupported where there are none; others stay as they are, with 0.

    Passages of documents that were not extracted do not count.
    """
    counts = passages.groupBy("document_id").agg(F.count("*").alias("_n"))
    joined = extracted.join(counts, "document_id", "left")
    read = F.coalesce(F.col("status") == "extracted", F.lit(False))
    empty = read & F.col("_n").isNull()
    return joined.withColumns(
        {
            "chunks": F.when(read, F.coalesce("_n", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")),
            "error_message": F.when(empty, "no passages").otherwise(F.col("error_message")),
            "status": F.when(empty, "unsupported").when(read, "indexed").otherwise(F.col("status")),
        }
    ).drop("_n")
