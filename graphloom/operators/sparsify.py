"""Edge scores that rank edges within neighbourhoods, and filters on scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.structure import degrees


def _both(scored: DataFrame) -> DataFrame:
    """(src, dst, score) of edges from (u, v, score) of arcs: the larger."""
    return scored.groupBy(F.greatest("u", "v").alias("src"), F.least("u", "v").alias("dst")).agg(F.max("score").alias("score"))


def _exponent(rank: Column, degree: Column) -> Column:
    """1 - ln(rank) / ln(degree); 1 for a single neighbour."""
    return F.when(degree > 1, 1 - F.log(rank) / F.log(degree)).otherwise(1.0)


def local_degree(g: Graph) -> DataFrame:
    """Each node ranks its neighbours by degree; ties share the rank."""
    g = g.materialized()
    d = degrees(g).select(F.col("node").alias("v"), F.col("degree").alias("dv"))
    a = g.arcs().where("u <> v").join(d, "v").withColumn("k", F.count("*").over(Window.partitionBy("u")))
    r = F.rank().over(Window.partitionBy("u").orderBy(F.desc("dv")))
    return _both(a.withColumn("r", r).select("u", "v", _exponent(F.col("r"), F.col("k")).alias("score")))


def local_filter(g: Graph, scores: DataFrame) -> DataFrame:
    """Each node ranks its edges by scores(src, dst, score), largest first; ties share the rank."""
    s = scores.select(F.col("src").alias("u"), F.col("dst").alias("v"), "score").union(scores.select("dst", "src", "score"))
    r, k = F.rank().over(Window.partitionBy("u").orderBy(F.desc("score"))), F.count("*").over(Window.partitionBy("u"))
    return _both(s.select("u", "v", r.alias("r"), k.alias("k")).select("u", "v", _exponent(F.col("r"), F.col("k")).alias("score")))


def disparity(g: Graph) -> DataFrame:
    """Multiscale score: 1 - (1 - w / strength)^(degree - 1), the larger of both ends."""
    g = g.materialized()
    d = degrees(g).select(F.col("node").alias("u"), "degree", "weighted_degree")
    a = g.arcs().where("u <> v").join(d, "u")
    return _both(a.select("u", "v", (1 - F.pow(1 - F.col("w") / F.col("weighted_degree"), F.col("degree") - 1)).alias("score")))


def normalised(scores: DataFrame, lower: float = 0.0, upper: float = 1.0, invert: bool = False) -> DataFrame:
    """scores stretched to [lower, upper]; inverted on request."""
    m = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    x = (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    x = 1 - x if invert else x
    return scores.join(F.broadcast(m)).select("src", "dst", (lower + (upper - lower) * x).alias("score"))


def above(g: Graph, scores: DataFrame, threshold: float) -> Graph:
    """Edges whose score is at least threshold."""
    return Graph(g.vertices, g.edges.join(scores.where(F.col("score") >= threshold).select("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst", "weight"), g.directed)
