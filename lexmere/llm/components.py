"""Connected components of an edge table, by alternating large-star and small-star steps.

Nothing is collected: each step is a grouped minimum and a join with it, each round
is written to the shared folder, and the rounds end when a round changes no edge.
A node with very many edges is no hot key: minima are combined before they are
exchanged, and joined by broadcast, all of them while they are few and those of
the large nodes (at most one for HUB edges) always. A round's tables have as many
parts as their edges need, so few edges are not dealt over all partitions of a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: minima are broadcast up to so many rows
BROADCAST_ROWS = 1_000_000
#: edges that make a node large
HUB = 10_000


#: edges of a part of a round's tables
PART_EDGES = 500_000


def _parts(n: int) -> int:
    """Parts for n edges; coalesce() leaves a table that has fewer as it is."""
    return max(1, -(-n // PART_EDGES))


def _lows(low: DataFrame, n: int) -> DataFrame:
    """low, of at most 2n rows, as it stands if that is few enough to be broadcast, else as a table."""
    return low.coalesce(_parts(n)) if 2 * n <= BROADCAST_ROWS else scratch.table(low, "low")


def _with_low(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """edges (a, b) with the low of a; low has (a, low, k), k the edges of a, for n edges."""
    if 2 * n <= BROADCAST_ROWS or low.count() <= BROADCAST_ROWS:
        return edges.join(F.broadcast(low.drop("k")), "a")
    hubs = scratch.table(low.where(F.col("k") > HUB).drop("k"), "hubs")
    if hubs.count() <= BROADCAST_ROWS:
        hubs = F.broadcast(hubs)
    few = edges.join(hubs.select("a"), "a", "left_anti").join(low.where(F.col("k") <= HUB).drop("k"), "a")
    return few.unionByName(edges.join(hubs, "a"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lows(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("k")), n)
    return _with_low(both.where("b > a"), low, n).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = _lows(down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("k")), n)
    joined = _with_low(down, low, n)
    return joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; the root is the component's smallest node."""
    now = scratch.table(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    mark, n = None, now.count()
    while True:
        # the large star has at most an edge for each it is given, the small star at most one more for each node
        wide = scratch.table(_large_star(now, n).distinct().coalesce(_parts(n)), "edges")
        now = scratch.table(_small_star(wide, n).distinct().coalesce(_parts(n)), "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark, n = tuple(found), found[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
