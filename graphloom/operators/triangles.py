"""Triangles and what is counted from them. Edges are directed to the larger (degree, id), which bounds wedges per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import meets
from graphloom.operators.structure import degrees
from graphloom.plans.scratch import materialize


def _rising(g: Graph) -> DataFrame:
    """(a, b): edges to the larger (degree, id)."""
    d = degrees(g).select("node", "degree")
    e = g.edges.where("src <> dst").select("src", "dst").join(d.select(F.col("node").alias("src"), F.col("degree").alias("x")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("y")), "dst")
    up = F.struct("x", "src") > F.struct("y", "dst")
    return materialize(e.select(F.when(up, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(up, F.col("src")).otherwise(F.col("dst")).alias("b")), "rising")


def triangles(g: Graph) -> DataFrame:
    """(a, b, c): each triangle once."""
    return meets.triangles(_rising(g.materialized()), "triples")


def triangles_by_node(g: Graph) -> DataFrame:
    t = meets.triangles(_rising(g.materialized()), "nodes").groupBy("node").agg(F.sum("t").alias("t"))
    return g.vertices.withColumnRenamed("id", "node").join(t, "node", "left").select("node", F.coalesce("t", F.lit(0)).alias("triangles"))


def triangles_by_edge(g: Graph) -> DataFrame:
    """(src, dst, triangles) of every edge."""
    g = g.materialized()
    t = meets.triangles(_rising(g), "edges").groupBy(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).agg(F.sum("t").alias("t"))
    return g.edges.select("src", "dst").join(t, ["src", "dst"], "left").select("src", "dst", F.coalesce("t", F.lit(0)).alias("triangles"))


def local_clustering(g: Graph) -> DataFrame:
    """2 t / (d (d - 1)); 0 below two neighbours."""
    g = g.materialized()
    d = degrees(g).select("node", "degree")
    return triangles_by_node(g).join(d, "node").select("node", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("score"))


def global_clustering(g: Graph) -> DataFrame:
    """One row: transitivity over all wedges, and the mean of local values over nodes of two neighbours or more."""
    g = g.materialized()
    d = degrees(g).select("node", "degree")
    t = triangles_by_node(g).join(d, "node").where("degree > 1")
    wedges = F.col("degree") * (F.col("degree") - 1)
    return t.agg((F.sum(2.0 * F.col("triangles")) / F.sum(wedges)).alias("transitivity"), F.avg(2.0 * F.col("triangles") / wedges).alias("average_local"))
