"""Incremental indexing: a file stream whose batches merge into versioned snapshots.

A table is kept in buckets of its key. A batch writes the buckets it changes as files
of their own, and then publishes a small list of every bucket's current files under
the next number. Lists are created once and never replaced: readers take the highest
number, a crash between leaves files that no list names, and of two writers that
merged into the same version the second finds its number taken and merges again.
Documents are hashed and looked up before the costly steps.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_id, owner_for
from ..operators import manifest as M
from ..sources import docx, shared
from ..sources.files import hashed, is_candidate

BUCKETS = 64


class Conflict(Exception):
    """Another writer has published the version that this one was to be."""


class Snapshots:
    """A table as numbered versions under a path, in buckets of a key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "document_id", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> int:
        """The number of the newest published version, 0 before the first."""
        fs, p = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return max((int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdecimal()), default=0)

    def _files(self, version: int) -> dict[str, str]:
        """The folder of each bucket in a version."""
        if not version:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{version}.json").collect()))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A version's rows, the newest one's where none is named; of some buckets alone no other files are opened."""
        files = self._files(self.current() if version is None else version)
        folders = sorted(files.values() if buckets is None else {files[str(b)] for b in buckets if str(b) in files})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets))

    def commit(self, table: DataFrame, base: int | None = None, changed: list[int] | None = None) -> int:
        """Publishes table as the next version after `base`; only the buckets in `changed` are written, where they are named."""
        base = self.current() if base is None else base
        self._publish(base + 1, self.written(table, base, changed))
        return base + 1

    def written(self, table: DataFrame, base: int, changed: list[int] | None = None) -> dict[str, str]:
        """The folders of the buckets of version `base` with table's rows in place of all of them, or of those in `changed`; published nowhere."""
        files = self._files(base)
        which = list(range(self.buckets)) if changed is None else changed
        made = f"data/{base + 1}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        bucketed = table.withColumn("bucket", self._bucket()).where(F.col("bucket").isin(which))
        bucketed.repartition(max(1, len(which)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{made}")
        fs, p = self._fs(f"{self.path}/{made}")
        written = {f.getPath().getName() for f in fs.listStatus(p)}
        for b in which:
            files.pop(str(b), None)
            if f"bucket={b}" in written:
                files[str(b)] = f"{made}/bucket={b}"
        return files

    def _publish(self, version: int, files: dict[str, str]) -> None:
        fs, p = self._fs(f"{self.path}/versions/{version}.json")
        fs.mkdirs(p.getParent())
        try:
            # created without overwriting: of two writers one gets the name, on any file system
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} is there") from None
            raise
        out.writeBytes(json.dumps(files))
        out.close()

    def merge(self, fresh: DataFrame, tries: int = 5) -> int:
        """Publishes the newest version with the fresh rows in place of those of equal keys; after a conflict, once more."""
        fresh = fresh.persist()
        try:
            changed = sorted(r[0] for r in fresh.select(self._bucket()).distinct().collect())
            for _ in range(tries):
                base = self.current()
                held = self.read(base, changed)
                try:
                    return self.commit(M.upsert(held, fresh.select(*held.columns), [self.key]), base, changed)
                except Conflict:
                    continue
            raise Conflict(f"no version after {tries} tries")
        finally:
            fresh.unpersist()

    def delete(self, gone: DataFrame, tries: int = 5) -> int:
        """Publishes the newest version without the keys in gone and returns how many rows they had; none had: no version."""
        keys = shared.written(gone.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "gone")
        named = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())
        for _ in range(tries):
            base = self.current()
            held = self.read(base, named)
            hit = [tuple(r) for r in held.join(keys, self.key, "left_semi").groupBy(self._bucket().alias("bucket")).count().collect()]
            if not hit:
                return 0
            changed = sorted(b for b, _ in hit)
            try:
                self.commit(self.read(base, changed).join(keys, self.key, "left_anti"), base, changed)
                return sum(n for _, n in hit)
            except Conflict:
                continue
        raise Conflict(f"no version after {tries} tries")

    def clear(self, tries: int = 5) -> int:
        """Publishes an empty version and returns how many rows the one before it had."""
        for _ in range(tries):
            base = self.current()
            n = self.read(base).count()
            try:
                self._publish(base + 1, {})
                return n
            except Conflict:
                continue
        raise Conflict(f"no version after {tries} tries")


class Library:
    """Several tables under one path that change together: a version names the files of all of them.

    A change writes the tables it names and publishes them at once, so a reader sees all of a
    change or nothing of it, and a change that fails on the way leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS):
        """tables: name -> (schema, key)."""
        self.path = path.rstrip("/")
        self.all = Snapshots(spark, self.path, "", buckets=buckets)
        self.tables = {name: _Part(self.all, name, schema, key, buckets) for name, (schema, key) in tables.items()}

    def current(self) -> int:
        return self.all.current()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.tables[name].read(version)

    def change(self, tables: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 5) -> int:
        """Publishes the tables that the function makes of the newest version's; after a conflict, of the version that came between."""
        for _ in range(tries):
            base = self.current()
            files = self.all._files(base)
            made = tables({name: part.read(base) for name, part in self.tables.items()})
            for name, rows in made.items():
                files = {k: v for k, v in files.items() if not k.startswith(f"{name}/")}
                files |= {f"{name}/{b}": f for b, f in self.tables[name].written(rows, base).items()}
            try:
                self.all._publish(base + 1, files)
                return base + 1
            except Conflict:
                continue
        raise Conflict(f"no version after {tries} tries")


class _Part(Snapshots):
    """One table of a library: its files are those that the library's versions name under it."""

    def __init__(self, whole: Snapshots, name: str, schema: str, key: str, buckets: int):
        super().__init__(whole.spark, whole.path, schema, key, buckets)
        self.whole, self.name = whole, name

    def _files(self, version: int) -> dict[str, str]:
        own = f"{self.name}/"
        return {k[len(own) :]: v for k, v in self.whole._files(version).items() if k.startswith(own)}


RECORD = "document_id string, filename string, filepath string, alt_filepaths array<string>, file_hash string, owner_id string, visibility string, status string, error_message string, title string, pages int"


def named_files(files: DataFrame, root: str) -> DataFrame:
    """What a run knows of its candidate files (path, length, content) without their content: hash, name, owner, document."""
    owned = hashed(files.where(is_candidate(F.col("path")))).withColumn("owner_id", owner_for(F.col("path"), root)).where("owner_id IS NOT NULL")
    return owned.withColumn("document_id", document_id(F.col("owner_id"), F.col("file_hash"))).drop("content")


def index_files(files: DataFrame, known: DataFrame, root: str, force: bool = False, extract: Callable[[DataFrame], DataFrame] = docx.extract, named: DataFrame | None = None) -> DataFrame:
    """RECORD for the files (path, length, content) that a run has to process, one row a document.

    named: named_files() of these, where it is at hand. Content is read again for fresh files alone.
    """
    named = named_files(files, root) if named is None else named
    fresh = M.pending(named.withColumnRenamed("path", "filepath"), known, force)
    paths = M.exact_duplicates(fresh.select("document_id", "filepath"))
    first = fresh.join(paths, ["document_id", "filepath"]).withColumnRenamed("filepath", "path")
    found = extract(files.select("path", "content").join(first.select("path"), "path", "left_semi")).withColumnRenamed("pages", "page_list")
    status = F.when(F.col("status") == "extracted", "indexed").otherwise(F.col("status"))
    joined = first.join(found, "path")
    return joined.select("document_id", "filename", F.col("path").alias("filepath"), "alt_filepaths", "file_hash", "owner_id", F.lit("private").alias("visibility"), status.alias("status"), "error_message", "title", F.size("page_list").alias("pages"))


def run_batch(snapshots: Snapshots, files: DataFrame, root: str) -> int:
    """Merges one batch of files into the manifest; returns the version's number."""
    known = snapshots.read()
    names = [c.split()[0] for c in RECORD.split(", ")]
    named = shared.written(named_files(files, root), "named")
    fresh = index_files(files, known, root, named=named).select(*names)
    found = named.select("document_id", "path")
    # a known document at a new path is not read again: the path joins its record
    moved = M.with_paths(known.where(F.col("status").isin(*M.TERMINAL)), found).select(*names)
    return snapshots.merge(fresh.unionByName(moved))


def sweep(snapshots: Snapshots, listing: DataFrame, tries: int = 5) -> int:
    """Drops from the records the paths that a whole listing (path) of the tree does not have.

    A record keeps its first path while it is there; else the next one takes its place,
    which is how a moved file keeps its document. A record without a path goes. Only the
    buckets of records that lose a path are written; after a conflict the newest version is swept.
    """
    there = listing.select("path").distinct()
    for _ in range(tries):
        base = snapshots.current()
        held = snapshots.read(base)
        paths = F.array_union(F.array("filepath"), F.coalesce("alt_filepaths", F.array().cast("array<string>")))
        lost = held.select(snapshots._bucket().alias("bucket"), F.explode(paths).alias("path")).join(there, "path", "left_anti")
        changed = sorted(r[0] for r in lost.select("bucket").distinct().collect())
        if not changed:
            return base
        try:
            return snapshots.commit(M.present(snapshots.read(base, changed), listing), base, changed)
        except Conflict:
            continue
    raise Conflict(f"no version after {tries} tries")


def start(spark: SparkSession, root: str, snapshots: Snapshots, checkpoint: str, batch_files: int = 1000):
    """A stream over a folder of uploads; stops when everything there is indexed."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", batch_files).load(root)
    plain = stream.withColumn("path", F.regexp_replace("path", r"^file:(//)?", ""))
    return plain.writeStream.foreachBatch(lambda df, _: run_batch(snapshots, df, root) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
