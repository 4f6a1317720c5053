"""Degrees, density, subgraphs and other one-pass properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph


def degrees(g: Graph) -> DataFrame:
    """(node, degree, weighted_degree): loops count once; outgoing in directed graphs."""
    d = g.arcs().groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"), F.sum("w").alias("w"))
    return g.vertices.join(d, "id", "left").select(F.col("id").alias("node"), F.coalesce("d", F.lit(0)).alias("degree"), F.coalesce("w", F.lit(0.0)).alias("weighted_degree"))


def in_degrees(g: Graph) -> DataFrame:
    return degrees(Graph(g.vertices, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), g.directed))


def isolated(g: Graph) -> DataFrame:
    return g.vertices.join(g.arcs().select(F.col("u").alias("id")).union(g.arcs().select("v")).distinct(), "id", "left_anti").select(F.col("id").alias("node"))


def size(g: Graph) -> DataFrame:
    """One row: nodes, edges, self_loops, total_weight, density = (m - loops) (x 2 if undirected) / (n (n - 1))."""
    n = g.vertices.agg(F.count("*").alias("nodes"))
    e = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
    d = (F.col("edges") - F.col("self_loops")) * (1.0 if g.directed else 2.0) / (F.col("nodes") * (F.col("nodes") - 1))
    one = F.lit(1).alias("_k")  # both sides are single rows
    return n.select("*", one).join(e.select("*", one), "_k").select("nodes", "edges", "self_loops", "total_weight", F.when(F.col("nodes") > 1, d).otherwise(0.0).alias("density"))


def degree_distribution(g: Graph) -> DataFrame:
    return degrees(g).groupBy("degree").agg(F.count("*").alias("nodes"))


def degree_centrality(g: Graph) -> DataFrame:
    """Degree over n - 1."""
    n = g.vertices.agg(F.count("*").alias("n"))
    return degrees(g).join(F.broadcast(n)).select("node", (F.col("degree") / (F.col("n") - 1)).alias("score"))


def subgraph(g: Graph, nodes: DataFrame) -> Graph:
    """The graph on nodes(id)."""
    e = g.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(g.vertices.join(nodes, "id", "left_semi"), e.select("src", "dst", "weight"), g.directed)


def transpose(g: Graph) -> Graph:
    if not g.directed:
        raise ValueError("an undirected graph has no transpose")
    return Graph(g.vertices, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), True)


def to_undirected(g: Graph) -> Graph:
    """Every arc becomes an edge, so opposite arcs become parallel edges."""
    return Graph.from_edges(g.edges, vertices=g.vertices, multi="keep")


def merge(g: Graph, other: Graph) -> Graph:
    """g with the nodes and the absent edges of other."""
    new = other.edges.join(g.edges, ["src", "dst"], "left_anti").select("src", "dst", "weight")
    return Graph(g.vertices.union(other.vertices).distinct(), g.edges.union(new), g.directed)


def sfigality(g: Graph) -> DataFrame:
    """Share of neighbours with a larger degree; 0 without neighbours."""
    d = degrees(g).select("node", "degree")
    a = g.arcs().join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    s = a.groupBy(F.col("u").alias("node")).agg((F.count_if(F.col("dv") > F.col("du")) / F.first("du")).alias("s"))
    return d.join(s, "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("score"))


def laplacian_centrality(g: Graph) -> DataFrame:
    """d² + sum of w (w + 2 d(v)) over neighbours v, d being the weighted degree cut to an integer where it stands alone."""
    d = degrees(g).select("node", "weighted_degree")
    a = g.arcs().join(d.select(F.col("node").alias("v"), F.col("weighted_degree").alias("dv")), "v")
    s = a.groupBy(F.col("u").alias("node")).agg(F.sum(F.col("w") * (F.col("w") + 2 * F.col("dv"))).alias("s"))
    own = F.floor("weighted_degree").cast("double")
    return d.join(s, "node", "left").select("node", (own * own + F.coalesce("s", F.lit(0.0))).alias("score"))


def degree_assortativity(g: Graph) -> DataFrame:
    """One row: Pearson correlation of degrees over edges, oriented src >= dst."""
    d = degrees(g).select("node", F.col("degree").cast("double").alias("k"))
    e = g.edges.join(d.select(F.col("node").alias("src"), F.col("k").alias("x")), "src").join(d.select(F.col("node").alias("dst"), F.col("k").alias("y")), "dst")
    return e.agg(F.corr("x", "y").alias("assortativity"))


def nominal_assortativity(g: Graph, types: DataFrame) -> DataFrame:
    """One row: (sum e_ii - sum a_i b_i) / (1 - sum a_i b_i) of types(node, type), the mixing matrix being symmetric."""
    t = lambda c, k: types.select(F.col("node").alias(c), F.col("type").alias(k))
    e = g.arcs().join(t("u", "tu"), "u").join(t("v", "tv"), "v").groupBy("tu", "tv").agg(F.count("*").alias("k"))
    total = e.agg(F.sum("k").alias("m"), F.sum(F.when(F.col("tu") == F.col("tv"), F.col("k")).otherwise(0)).alias("same"))
    ab = e.groupBy("tu").agg(F.sum("k").alias("a")).agg(F.sum(F.col("a").cast("double") * F.col("a")).alias("ab"))
    r = (F.col("same") / F.col("m") - F.col("ab") / (F.col("m") * F.col("m"))) / (1 - F.col("ab") / (F.col("m") * F.col("m")))
    return total.join(F.broadcast(ab)).select(r.alias("assortativity"))
