"""A tree walk as a Spark data source: files of several roots, each folder once, excluded subtrees never entered.

    spark.dataSource.register(TreeWalk)
    spark.read.format("tree_walk").option("roots", "/a\\n/b").option("without", "/a/users").load()

The roots' upper folders, split down while they are few, are the partitions, so executors walk
side by side; they must see the roots under the same paths, as on a mounted store. A filter
`NOT path LIKE 'prefix/%'` is pushed down and prunes the walk like the option `without`.
Roots that lie in one another, and links, bring a file once. A root that is not there is empty.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, Not, StringStartsWith

SCHEMA = "path string, name string, length long, modified_at timestamp"
#: folders are split down until there are so many partitions
PARTITIONS = 64


@dataclass
class Folder(InputPartition):
    """A folder to walk: with all that is below it, or its own files alone."""

    path: str
    deep: bool


def _below(path: str, prefixes: list[str]) -> bool:
    return any(path == p or path.startswith(p + "/") for p in prefixes)


class Walk(DataSourceReader):
    def __init__(self, options: dict):
        clean = lambda key: [os.path.realpath(x) for x in options.get(key, "").split("\n") if x.strip()]
        roots = sorted(set(clean("roots")))
        # a root inside another is walked with it
        self.roots = [r for r in roots if not any(r.startswith(o.rstrip("/") + "/") for o in roots if o != r)]
        self.without = clean("without")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, Not) and isinstance(f.child, StringStartsWith) and f.child.attribute == ("path",) and f.child.value.endswith("/"):
                self.without.append(f.child.value.rstrip("/"))  # a folder with all below it
            else:
                yield f

    def partitions(self) -> list[Folder]:
        todo = [r for r in self.roots if os.path.isdir(r) and not _below(r, self.without)]
        out: list[Folder] = []
        while todo and len(todo) + len(out) < PARTITIONS:
            folder = todo.pop(0)
            below = sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not _below(e.path, self.without))
            out.append(Folder(folder, False))
            todo += below
        return out + [Folder(f, True) for f in todo] or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not partition.path:
            return
        for folder, below, names in os.walk(partition.path):
            if not partition.deep:
                below.clear()
            below[:] = sorted(b for b in below if not _below(os.path.join(folder, b), self.without))
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    found = os.stat(path)
                except FileNotFoundError:  # gone since it was listed
                    continue
                yield path, name, found.st_size, dt.datetime.fromtimestamp(found.st_mtime, dt.timezone.utc)


class TreeWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Walk:
        return Walk(self.options)


def walk(spark: SparkSession, roots: list[str], without: list[str] | None = None) -> DataFrame:
    """SCHEMA: the files of the roots, without those below some folders, each once, in the order of their paths."""
    spark.dataSource.register(TreeWalk)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("tree_walk").option("roots", "\n".join(roots)).option("without", "\n".join(without or [])).load()
    return found.dropDuplicates(["path"]).orderBy("path")


def library(spark: SparkSession, roots: list[str], users_root: str) -> DataFrame:
    """Supported files of the roots outside the users' folders."""
    from .files import is_candidate

    return walk(spark, roots, [users_root]).where(is_candidate(F.col("path")))
