"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u, and nothing else, goes to the least of u and its neighbours."""
    sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours go to the least of those."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge that is not a loop; the component is its least node.

    Each step is an aggregation with map-side combine and an equi-join that AQE may split;
    the number of rounds grows with the logarithm of the node count. Null ends are ignored.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("_s"), F.col(dst).alias("_d"))
        .where("_s IS NOT NULL AND _d IS NOT NULL AND u > v")
        .select("u", "v")
        .distinct()
    )
    cur, before = materialize(e, "cc"), None
    while True:
        nxt = materialize(_small_star(_large_star(cur)), "cc")
        # a forest of stars is a fixed point: the same number of edges, and the same multiset of them
        state = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(cur)
        cur = nxt
        if before == state:
            break
        before = state
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
