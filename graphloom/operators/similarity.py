"""Link prediction indices of node pairs, and similarity scores of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import meets
from graphloom.operators.structure import degrees
from graphloom.operators.triangles import triangles_by_edge
from graphloom.plans.scratch import materialize


def _degree_of(g: Graph, node: str, name: str) -> DataFrame:
    return degrees(g).select(F.col("node").alias(node), F.col("degree").alias(name))


def common_neighbours(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(u, v, common, adamic_adar, resource_allocation) of pairs(u, v), by default all pairs u < v with a common neighbour."""
    a = g.arcs().where("u <> v").select(F.col("u").alias("m"), F.col("v").alias("n"))
    d = _degree_of(g, "m", "d")
    by = a.join(d, "m")
    if pairs is None:
        meet = by.select("m", "d", F.col("n").alias("u")).join(a.select("m", F.col("n").alias("v")), "m").where("u < v")
        return meet.groupBy("u", "v").agg(F.count("*").alias("common"), F.sum(1 / F.log("d")).alias("adamic_adar"), F.sum(1 / F.col("d")).alias("resource_allocation"))
    near = materialize(by.select(F.col("n").alias("node"), F.col("m").alias("x"), F.col("d").alias("tag")).distinct(), "near")
    out = meets.of_pairs(pairs, near, near, "neighbours").where("common > 0").select("u", "v", "common", F.col("s").alias("adamic_adar"), F.col("t").alias("resource_allocation"))
    zero = {"common": F.coalesce("common", F.lit(0)), "adamic_adar": F.coalesce("adamic_adar", F.lit(0.0)), "resource_allocation": F.coalesce("resource_allocation", F.lit(0.0))}
    return pairs.select("u", "v").join(out, ["u", "v"], "left").withColumns(zero)


def predict(g: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v) with common, jaccard, total_neighbours (union), preferential_attachment, adamic_adar, resource_allocation, neighbourhood_distance."""
    g = g.materialized()
    c = common_neighbours(g, pairs).join(_degree_of(g, "u", "du"), "u").join(_degree_of(g, "v", "dv"), "v")
    union = F.col("du") + F.col("dv") - F.col("common")
    return c.select(
        "u", "v", "common", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("jaccard"), union.alias("total_neighbours"),
        (F.col("du") * F.col("dv")).alias("preferential_attachment"), "adamic_adar", "resource_allocation",
        F.when(F.col("du") * F.col("dv") > 0, F.col("common") / F.sqrt(F.col("du") * F.col("dv"))).otherwise(0.0).alias("neighbourhood_distance"),
    )


def edge_scores(g: Graph) -> DataFrame:
    """(src, dst, triangles, jaccard_distance, scan) of every edge."""
    g = g.materialized()
    e = triangles_by_edge(g).join(_degree_of(g, "src", "a"), "src").join(_degree_of(g, "dst", "b"), "dst")
    t, a, b = F.col("triangles"), F.col("a"), F.col("b")
    return e.select("src", "dst", "triangles", (1 - t / (a + b - t)).alias("jaccard_distance"), ((t + 1) / F.sqrt((a + 1) * (b + 1))).alias("scan"))
