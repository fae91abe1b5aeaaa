"""Folder trees as adjacency lists: subtrees, ancestors, heights, moves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folder_name
from ..sources import shared

MOST_LEVELS = 20
MOST_FOLDERS = 5000


def _levels(first: DataFrame, step: Callable[[DataFrame, int], DataFrame], most: int) -> DataFrame:
    """The rows of the first level, what a step (of a level's rows, the next one's number) makes of them, and so on: until none are left, or for `most` levels.

    Each level is written once, so a level is one join whatever the number of folders; a
    recursive query ends with an error at the session's limit of rows.
    """
    spark, path = first.sparkSession, shared.fresh(first.sparkSession, "levels")
    held, found = first, []
    while len(found) < most:
        own = f"{path}/{len(found)}"
        held.write.parquet(own)
        level = spark.read.schema(first.schema).parquet(own)
        found.append(own)
        if level.isEmpty():
            break
        held = step(level, len(found))
    return spark.read.schema(first.schema).parquet(*found)


def paths(folders: DataFrame) -> DataFrame:
    """(folder_id, parent_id, name, depth, path) for every folder below the roots."""
    own = folders.select("folder_id", "parent_id", "name")

    def below(level: DataFrame, n: int) -> DataFrame:
        above = level.select(F.col("folder_id").alias("parent_id"), F.col("path").alias("_path"))
        return own.join(above, "parent_id").select("folder_id", "parent_id", "name", F.lit(n + 1).alias("depth"), F.concat("_path", F.lit("/"), "name").alias("path"))

    roots = own.where("parent_id IS NULL").select("folder_id", "parent_id", "name", F.lit(1).alias("depth"), F.concat(F.lit("/"), "name").alias("path"))
    return _levels(roots, below, MOST_LEVELS)


def subtree(folders: DataFrame, root: str) -> DataFrame:
    """(folder_id, level) of a folder and all below it."""
    own = folders.select("folder_id", "parent_id")

    def below(level: DataFrame, n: int) -> DataFrame:
        return own.join(level.select(F.col("folder_id").alias("parent_id")), "parent_id").select("folder_id", F.lit(n).alias("level"))

    return _levels(own.where(F.col("folder_id") == root).select("folder_id", F.lit(0).alias("level")), below, MOST_LEVELS + 1)


def ancestors(folders: DataFrame, leaf: str) -> DataFrame:
    """(folder_id, name, level) from a folder up to its root."""
    own = folders.select("folder_id", "parent_id", "name")

    def above(level: DataFrame, n: int) -> DataFrame:
        return own.join(level.select(F.col("parent_id").alias("folder_id")), "folder_id").select("folder_id", "parent_id", "name", F.lit(n).alias("level"))

    first = own.where(F.col("folder_id") == leaf).withColumn("level", F.lit(0))
    return _levels(first, above, MOST_LEVELS + 1).select("folder_id", "name", "level")


def heights(folders: DataFrame) -> DataFrame:
    """(folder_id, height): 1 for a folder without folders in it.

    Folders of a height of at least k + 1 are the parents of those of at least k, so each
    level has fewer rows than the one before, and no pairs of a folder and one below it.
    """
    own = folders.select("folder_id", "parent_id")

    def above(level: DataFrame, n: int) -> DataFrame:
        return own.join(level.select(F.col("parent_id").alias("folder_id")), "folder_id", "left_semi").withColumn("height", F.lit(n + 1))

    found = _levels(own.withColumn("height", F.lit(1)), above, MOST_LEVELS)
    return found.groupBy("folder_id").agg(F.max("height").alias("height"))


def counted(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders with their paths and direct files; the row without a folder counts the root's."""
    direct = files.groupBy("folder_id").agg(F.count("*").alias("files"))
    named = paths(folders).select("folder_id", "path", "depth").unionByName(folders.sparkSession.createDataFrame([(None, "/", 0)], "folder_id string, path string, depth int"))
    return named.join(direct, named["folder_id"].eqNullSafe(direct["folder_id"]), "left").select(named["folder_id"], "path", "depth", F.coalesce("files", F.lit(0)).alias("files"))


def files_under(folders: DataFrame, files: DataFrame, root: str) -> DataFrame:
    return files.join(subtree(folders, root), "folder_id", "left_semi")


def move_targets(folders: DataFrame, moved: list[str]) -> DataFrame:
    """Every folder that is neither moved nor below a moved one."""
    out = folders
    for f in moved:
        out = out.join(subtree(folders, f), "folder_id", "left_anti")
    return out


def _clash_key(name):
    """Names compare without regard to ASCII case only."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sibling_clashes(folders: DataFrame) -> DataFrame:
    """(folder_id, other_id): folders whose name another one of their parent, the root too, has: the first by id."""
    same = Window.partitionBy("parent_id", _clash_key(F.col("name")))
    return folders.select("folder_id", F.min("folder_id").over(same).alias("other_id")).where("folder_id <> other_id")


def in_order(folders: DataFrame) -> DataFrame:
    """Folders with their place among their siblings, without regard to ASCII case."""
    order = Window.partitionBy("parent_id").orderBy(_clash_key(F.col("name")), "name", "folder_id")
    return folders.withColumn("place", F.row_number().over(order))


def file_order(name: Column | str) -> list[Column]:
    """The order of files by name: without regard to case in any script, equal names by their signs."""
    c = F.col(name) if isinstance(name, str) else name
    return [F.lower(F.upper(c)), c]


def _folded(name: str) -> str:
    """A name as _clash_key has it."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)


def create(folders: DataFrame, folder_id: str, parent: str | None, name: str, most: int | None = MOST_FOLDERS) -> DataFrame:
    """The folders with one more, or a ValueError: depth, number and sibling names are checked."""
    if most is not None and folders.count() >= most:
        raise ValueError("too many folders")
    if parent is not None and ancestors(folders, parent).count() in (0, *range(MOST_LEVELS, MOST_LEVELS + 2)):
        raise ValueError("no such parent, or too deep")
    own = folders.where(F.col("parent_id").eqNullSafe(F.lit(parent)) & (_clash_key(F.col("name")) == _clash_key(F.lit(name))))
    if own.limit(1).count():
        raise ValueError("the name is taken")
    fresh = folders.sparkSession.createDataFrame([(folder_id, parent, name)], "folder_id string, parent_id string, name string")
    return folders.select("folder_id", "parent_id", "name").unionByName(fresh)


def move(folders: DataFrame, moved: str, to: str | None) -> DataFrame:
    """The folders after a move: no cycle, no more than MOST_LEVELS, a taken name gets a number."""
    if to is not None:
        below = subtree(folders, moved)
        if below.where(F.col("folder_id") == to).limit(1).count():
            raise ValueError("a folder cannot move into itself")
        height = below.agg(F.max("level")).first()[0] + 1
        if ancestors(folders, to).count() + height > MOST_LEVELS:
            raise ValueError("too deep")
    name = folders.where(F.col("folder_id") == moved).first()["name"]
    taken = {r[0] for r in folders.where(F.col("parent_id").eqNullSafe(F.lit(to)) & (F.col("folder_id") != moved)).select(_clash_key(F.col("name"))).collect()}
    free, k = name, 2
    while _folded(free) in taken:
        free, k = f"{name} ({k})", k + 1
    own = F.col("folder_id") == moved
    return folders.withColumns({"parent_id": F.when(own, F.lit(to)).otherwise(F.col("parent_id")), "name": F.when(own, F.lit(free)).otherwise(F.col("name"))})


def delete(folders: DataFrame, files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Folders without a subtree, and files that were in it at the root."""
    gone = subtree(folders, root).select("folder_id", F.lit(True).alias("gone"))
    left = folders.join(gone, "folder_id", "left_anti")
    fallen = files.join(gone, "folder_id", "left").withColumn("folder_id", F.when(F.col("gone"), F.lit(None).cast("string")).otherwise(F.col("folder_id"))).drop("gone")
    return left, fallen


def rename(folders: DataFrame, folder_id: str, name: str) -> DataFrame:
    """The folders with one under another name, or a ValueError: the name is cleaned and must be free among its siblings."""
    own = folders.where(F.col("folder_id") == folder_id).select("parent_id", folder_name(F.lit(name)).alias("clean")).first()
    if own is None:
        raise ValueError("no such folder")
    if own["clean"] is None:
        raise ValueError("no name for a folder")
    same = F.col("parent_id").eqNullSafe(F.lit(own["parent_id"])) & (_clash_key(F.col("name")) == _clash_key(F.lit(own["clean"]))) & (F.col("folder_id") != folder_id)
    if folders.where(same).limit(1).count():
        raise ValueError("the name is taken")
    return folders.withColumn("name", F.when(F.col("folder_id") == folder_id, own["clean"]).otherwise(F.col("name")))


def move_files(folders: DataFrame, files: DataFrame, moved: DataFrame, to: str | None) -> DataFrame:
    """Files with those in moved (file_id) in another folder; a ValueError where the folder or a file is not there."""
    asked = moved.select("file_id").distinct()
    if to is not None and not folders.where(F.col("folder_id") == to).limit(1).count():
        raise ValueError("no such folder")
    if asked.join(files, "file_id", "left_anti").limit(1).count():
        raise ValueError("no such file")
    marked = files.join(asked.withColumn("_moved", F.lit(True)), "file_id", "left")
    return marked.withColumn("folder_id", F.when(F.col("_moved"), F.lit(to)).otherwise(F.col("folder_id"))).drop("_moved").select(*files.columns)


def placed(placements: DataFrame, fresh: DataFrame) -> DataFrame:
    """Placements (path, folder_id, ...) with fresh ones added; a path that is there takes the new folder and keeps its other columns."""
    new = fresh.select("path", F.col("folder_id").alias("_folder"), F.lit(True).alias("_new"))
    kept = placements.join(new, "path", "left").withColumn("folder_id", F.when(F.col("_new"), F.col("_folder")).otherwise(F.col("folder_id"))).select(*placements.columns)
    return kept.unionByName(fresh.join(placements, "path", "left_anti"), allowMissingColumns=True)


def forgotten(placements: DataFrame, paths: DataFrame | None = None, tree: str | None = None) -> DataFrame:
    """Placements without some paths, or without all of a tree."""
    out = placements if paths is None else placements.join(paths.select("path"), "path", "left_anti")
    return out if tree is None else out.where(~F.col("tree").eqNullSafe(F.lit(tree)))


def relocated(placements: DataFrame, moves: DataFrame) -> DataFrame:
    """Files moved on disk, (old, new), keep their folder: the old path's row takes the new path, or gives it its folder where the new one is listed."""
    from_ = placements.join(moves, F.col("path") == F.col("old")).select("new", F.col("folder_id").alias("_folder"))
    given = placements.join(from_, F.col("path") == F.col("new"), "left").withColumn("folder_id", F.when(F.col("new").isNotNull(), F.col("_folder")).otherwise(F.col("folder_id"))).select(*placements.columns)
    listed = placements.select(F.col("path").alias("_listed"))
    gone = moves.join(listed, F.col("new") == F.col("_listed"), "left")
    moved = given.join(gone, F.col("path") == F.col("old"), "left")
    left = moved.where(F.col("old").isNull() | F.col("_listed").isNull())
    return left.withColumn("path", F.coalesce("new", "path")).select(*placements.columns)


def adopt(folders: DataFrame, placements: DataFrame, moved: DataFrame, old_tree: str, new_tree: str, home_id: str, home_name: str) -> tuple[DataFrame, DataFrame]:
    """A tree's folders and files in another tree, all in a new folder there with a free name.

    folders and placements have a column tree; moved is (old, new) paths. A file of the
    old tree that is not in moved is dropped; one without a folder goes to the new one.
    """
    mine = F.col("tree") == old_tree
    tops = {r[0] for r in folders.where((F.col("tree") == new_tree) & F.col("parent_id").isNull()).select(_clash_key(F.col("name"))).collect()}
    name, k = home_name, 2
    while _folded(name) in tops:
        name, k = f"{home_name} ({k})", k + 1
    parent = F.when(mine & F.col("parent_id").isNull(), home_id).otherwise(F.col("parent_id"))
    kept = folders.withColumns({"parent_id": parent, "tree": F.when(mine, new_tree).otherwise(F.col("tree"))})
    home = folders.sparkSession.createDataFrame([(home_id, None, name, new_tree)], "folder_id string, parent_id string, name string, tree string")
    old = placements.where(mine).select(F.col("path").alias("old"), F.col("folder_id").alias("_folder"))
    fresh = moved.join(old, "old", "left").select(F.col("new").alias("path"), F.coalesce("_folder", F.lit(home_id)).alias("folder_id"), F.lit(new_tree).alias("tree"))
    return kept.unionByName(home, allowMissingColumns=True), placed(placements.where(~mine), fresh)
