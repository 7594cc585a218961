"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one grouped minimum (combined before the shuffle, so a vertex with a third of all edges is no
hot group) and one equi-join, which adaptive execution may split.  The number of rounds is logarithmic in the
component size.  Edges never reach the driver: a round ends with two numbers, a count and a hash sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, keep

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v, distinct."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.filter("u > v")
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every vertex of an edge (null and self edges do not count): comp is the smallest id reachable."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = keep(now, "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        large = keep(_star(now, True), "large")
        after = keep(_star(large, False), "small")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(large)
        drop(now)
        now = after
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
