"""Measures of shortest paths from many sources: distances, closeness, betweenness, eccentricity.

Every operator takes sources(id); None means all nodes. Work grows with sources, 63 of which go together where only
counts are asked for, and tables of distances with sources times reached nodes, so large graphs take a sample of sources. Paths count hops; parallel edges count as paths of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.multisource import reach_counts
from graphloom.plans.scratch import materialize


def _levels(g: Graph, sources: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """The arcs, and for each hop the pairs (source, node, paths) first reached by it."""
    arcs = materialize(g.arcs().where("u <> v").select("u", "v"), "arcs")
    chosen = g.vertices if sources is None else sources.join(g.vertices, "id", "left_semi").distinct()
    levels = [materialize(chosen.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("paths")), "level")]
    while not levels[-1].isEmpty():
        front = levels[-1].withColumnRenamed("node", "u")
        reach = arcs.join(front, "u").groupBy("source", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        known = levels if g.directed else levels[-2:]  # an undirected edge leads back by one level at most
        for level in known:
            reach = reach.join(level.select("source", "node"), ["source", "node"], "left_anti")
        levels.append(materialize(reach, "level"))
    return arcs, levels[:-1] or levels


def distances(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(source, node, distance, paths) of all nodes that each source reaches, itself included."""
    _, levels = _levels(g, sources)
    return reduce(DataFrame.union, [x.select("source", "node", F.lit(h).alias("distance"), "paths") for h, x in enumerate(levels)])


def closeness(g: Graph, normalized: bool = False, generalized: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """(node, score) of the sources: 1 / sum of distances, times n - 1 if normalized; 0 where nothing is reached.

    Generalized, for graphs of several components: (reached - 1)^2 / (sum (n - 1)), reached counting the node itself.
    """
    n = g.vertices.count()
    d = reach_counts(g, sources).groupBy(F.col("source").alias("node")).agg(F.sum(F.col("hop") * F.col("nodes")).cast("double").alias("s"), F.sum("nodes").alias("reached"))
    if generalized:
        score = (F.col("reached") - 1) * (F.col("reached") - 1) / F.col("s") / max(n - 1, 1)
    else:
        score = (n - 1 if normalized else 1) / F.col("s")
    return d.select("node", F.when(F.col("s") > 0, score).otherwise(0.0).alias("score"))


def harmonic_closeness(g: Graph, normalized: bool = True, sources: DataFrame | None = None) -> DataFrame:
    """(node, score) of the sources: the sum of 1 / distance, over n - 1 if normalized."""
    n = max(g.vertices.count() - 1, 1) if normalized else 1
    each = F.when(F.col("hop") > 0, F.col("nodes") / F.col("hop")).otherwise(0.0)
    return reach_counts(g, sources).groupBy(F.col("source").alias("node")).agg((F.sum(each) / n).alias("score"))


def eccentricity(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(node, eccentricity) of the sources: the distance of the farthest node reached."""
    return reach_counts(g, sources).groupBy(F.col("source").alias("node")).agg(F.max("hop").alias("eccentricity"))


def diameter(g: Graph) -> DataFrame:
    """One row: diameter and radius over reached nodes; null without nodes."""
    return eccentricity(g).agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"))


def distance_distribution(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(distance, pairs): ordered pairs of different nodes by distance."""
    return reach_counts(g, sources).where("hop > 0").groupBy(F.col("hop").alias("distance")).agg(F.sum("nodes").alias("pairs"))


def dependencies(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(source, node, distance, paths, own) of all nodes that each source reaches: own is the share of the source's shortest paths that pass through the node, 0 for the source itself.

    Shares flow back one level at a time: each level is one join along the arcs into the level before.
    """
    arcs, levels = _levels(g, sources)
    below, parts = None, [levels[0].select("source", "node", F.lit(0).alias("distance"), "paths", F.lit(0.0).alias("own"))]
    for h in range(len(levels) - 1, 0, -1):
        here = levels[h].withColumn("own", F.lit(0.0))
        if below is not None:
            back = arcs.join(below.withColumnRenamed("node", "v"), "v").groupBy("source", F.col("u").alias("node")).agg(F.sum((1 + F.col("own")) / F.col("paths")).alias("back"))
            here = levels[h].join(back, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("back", F.lit(0.0))).alias("own"))
        below = materialize(here, "dependency")
        parts.append(below.select("source", "node", F.lit(h).alias("distance"), "paths", "own"))
    return reduce(DataFrame.union, parts)


def betweenness(g: Graph, normalized: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """(node, score): dependencies summed over ordered pairs, over (n - 1)(n - 2) if normalized.

    With sampled sources the sums are scaled by n over their number.
    """
    n = g.vertices.count()
    rows = dependencies(g, sources)
    took = n if sources is None else rows.where("distance = 0").count()
    scale = (n / took if took else 1.0) / ((n - 1) * (n - 2) if normalized and n > 2 else 1)
    sums = rows.groupBy("node").agg(F.sum("own").alias("own"))
    return g.vertices.withColumnRenamed("id", "node").join(sums, "node", "left").select("node", (F.coalesce("own", F.lit(0.0)) * scale).alias("score"))
