"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.session import keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges u > v; hot nodes are a key of aggregates and of splittable joins only."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Large star: each node links its larger neighbours to its smallest one.
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = keep(large.distinct(), "stars")
    # Small star: each node links its smaller neighbours, and itself, to the smallest.
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for each node of the edges (u, v), where root is its component's smallest node.

    Edges may repeat, point either way or join a node to itself; nodes without a proper edge are
    not listed. Every round ends in a written table; the number of rounds grows with the logarithm
    of the longest path.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = keep(pairs.distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = _stars(now)
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
