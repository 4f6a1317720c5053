"""Edge scores and sparsifiers beyond local degree, local filter and disparity. Scores are (src, dst, score)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import meets
from graphloom.kernels.csr import Csr, collect, frame
from graphloom.operators import sparsify as S
from graphloom.operators.structure import degrees
from graphloom.operators.triangles import triangles_by_edge
from graphloom.plans.numbering import numbered
from graphloom.plans.scratch import materialize


def _degree(g: Graph, node: str, name: str) -> DataFrame:
    return degrees(g).select(F.col("node").alias(node), F.col("degree").alias(name))


def _sides(scores: DataFrame) -> DataFrame:
    return scores.select(F.col("src").alias("u"), F.col("dst").alias("v"), "score").union(scores.select("dst", "src", "score"))


def _triangles(g: Graph) -> DataFrame:
    return triangles_by_edge(g).withColumnRenamed("triangles", "score")


def quadrangles(g: Graph) -> DataFrame:
    """Cycles of four nodes that each edge u-v is in: pairs of a neighbour x of u and y of v with x-y linked, x <> v, y <> u."""
    a = materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "arcs")
    # paths x-u and v-y of an edge meet in common neighbours: c(v, x) - 1 of them go round by u alone
    two = a.select(F.col("u").alias("m"), F.col("v").alias("x")).join(a.select(F.col("u").alias("m"), F.col("v").alias("y")), "m").where("x <> y").groupBy("x", "y").agg(F.count("*").alias("c"))
    e = g.edges.where("src <> dst").select("src", "dst").distinct()
    q = e.join(a.select(F.col("u").alias("src"), F.col("v").alias("x")), "src").where("x <> dst").join(two.select(F.col("x").alias("dst"), F.col("y").alias("x"), "c"), ["dst", "x"])
    s = q.groupBy("src", "dst").agg(F.sum(F.col("c") - 1).alias("s"))
    return g.edges.select("src", "dst").join(s, ["src", "dst"], "left").select("src", "dst", F.coalesce("s", F.lit(0)).alias("score"))


def as_weights(g: Graph, scores: DataFrame, squared: bool = False, offset: float = 1.0, factor: float = 1.0) -> Graph:
    """g with weights offset + factor * score (or its square)."""
    x = F.col("score") * F.col("score") if squared else F.col("score")
    return Graph(g.vertices, g.edges.select("src", "dst").join(scores, ["src", "dst"]).select("src", "dst", (offset + factor * x).alias("weight")), g.directed)


def blended(first: DataFrame, second: DataFrame, chosen: DataFrame) -> DataFrame:
    """The second score for edges in chosen (src, dst), the first for others."""
    c = chosen.select("src", "dst", F.lit(True).alias("c")).distinct()
    b = first.join(second.withColumnRenamed("score", "s2"), ["src", "dst"]).join(c, ["src", "dst"], "left")
    return b.select("src", "dst", F.when(F.col("c"), F.col("s2")).otherwise(F.col("score")).alias("score"))


def linearized(scores: DataFrame, inverse: bool = False, seed: int = 1) -> DataFrame:
    """Rank over m - 1 (0.5 for a single edge), ties in random order by a hash."""
    s = F.desc("score") if inverse else F.asc("score")
    n = numbered(scores, s, F.xxhash64("src", "dst", F.lit(seed)), "src", "dst", name="r")
    m = scores.count()
    return n.select("src", "dst", (F.col("r") / (m - 1) if m > 1 else F.lit(0.5)).alias("score"))


def geometric_mean(scores: DataFrame) -> DataFrame:
    """Score over the root of the product of both ends' sums; 0 where the score is not above 0."""
    sums = _sides(scores).groupBy("u").agg(F.sum("score").alias("s"))
    b = scores.join(sums.select(F.col("u").alias("src"), F.col("s").alias("a")), "src").join(sums.select(F.col("u").alias("dst"), F.col("s").alias("b")), "dst")
    return b.select("src", "dst", F.when(F.col("score") > 0, F.col("score") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0).alias("score"))


def _ranked(scores: DataFrame) -> DataFrame:
    """(u, v, r): each node's neighbours by falling score, ties sharing the least rank, from 0."""
    return _sides(scores).withColumn("r", F.rank().over(Window.partitionBy("u").orderBy(F.desc("score"))) - 1).select("u", "v", "r")


def _written(scores: DataFrame) -> DataFrame:
    return scores if hasattr(scores, "_scratch_path") else materialize(scores, "scores")


def _lists(ranked: DataFrame) -> DataFrame:
    return ranked.where("u <> v").select(F.col("u").alias("node"), F.col("v").alias("x"), F.col("r").alias("tag"))


def _pairs(scores: DataFrame) -> DataFrame:
    return scores.select(F.col("src").alias("u"), F.col("dst").alias("v"))


def simmelian_overlap(scores: DataFrame, max_rank: int) -> DataFrame:
    """How many nodes are among the neighbours of rank up to max_rank of both ends, the ends themselves left out."""
    scores = _written(scores)
    r = materialize(_lists(_ranked(scores).where(F.col("r") <= max_rank)), "ranked")
    both = meets.of_pairs(_pairs(scores), r, r, "count").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("common").alias("k"))
    return scores.select("src", "dst").join(both, ["src", "dst"], "left").select("src", "dst", F.coalesce("k", F.lit(0)).cast("double").alias("score"))


def prefix_jaccard(scores: DataFrame) -> DataFrame:
    """The largest Jaccard index over all ranks of both ends' neighbours up to that rank, the ends left out."""
    scores = _written(scores)
    r = materialize(_lists(_ranked(scores)), "ranked")
    best = meets.of_pairs(_pairs(scores), r, r, "prefix").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("s").alias("j"))
    return scores.select("src", "dst").join(best, ["src", "dst"], "left").select("src", "dst", F.coalesce("j", F.lit(0.0)).alias("score"))


def chance_corrected(g: Graph) -> DataFrame:
    """Triangles over those expected: t (n - 2) / ((du - 1)(dv - 1)); 1 where an end has no other neighbour."""
    g, n = g.materialized(), g.vertices.count()
    t = _triangles(g).join(_degree(g, "src", "a"), "src").join(_degree(g, "dst", "b"), "dst")
    room = (F.col("a") - 1) * (F.col("b") - 1)
    return t.select("src", "dst", F.when(room > 0, F.col("score") * (n - 2) / room).otherwise(1.0).alias("score"))


def local_similarity(g: Graph) -> DataFrame:
    """Each node ranks its neighbours by Jaccard index, one after another; exponents as for local degree, the larger of both ends."""
    g = g.materialized()
    t = _triangles(g).join(_degree(g, "src", "a"), "src").join(_degree(g, "dst", "b"), "dst")
    j = t.select("src", "dst", (F.col("score") / (F.col("a") + F.col("b") - F.col("score"))).alias("score"))
    w = Window.partitionBy("u")
    s = _sides(j).select("u", "v", F.row_number().over(w.orderBy(F.desc("score"), "v")).alias("r"), F.count("*").over(w).alias("k"))
    return S._both(s.select("u", "v", S._exponent(F.col("r"), F.col("k")).alias("score")))


def random_edge(g: Graph, seed: int = 1) -> DataFrame:
    """Uniform in (0, 1) by a hash of the edge."""
    return g.edges.select("src", "dst", ((F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("score"))


def random_node_edge(g: Graph, ratio: float = 0.8, seed: int = 1) -> DataFrame:
    """An order of removal: with probability ratio an edge is judged by the random number of one end, else by its own."""
    h = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    node = F.least(h("src", F.lit(1)), h("dst", F.lit(1))) + h("src", "dst", F.lit(2)) * 1e-9
    return linearized(g.edges.select("src", "dst", F.when(h("src", "dst", F.lit(3)) < ratio, node).otherwise(h("src", "dst", F.lit(4))).alias("score")))


def forest_fire(g: Graph, pf: float = 0.6, ratio: float = 1.0, seed: int = 1) -> DataFrame:
    """Burnt edges over the most burnt: fires start at random nodes and pass to a geometric number of unburnt neighbours, until ratio * m edges have burnt. On the driver."""
    c = collect(g)
    rng, burnt, total = np.random.default_rng(seed), np.zeros(max(c.m, 1)), 0
    while total < ratio * c.m and c.m:
        u = int(rng.integers(c.n))
        seen, queue = {u}, [u]
        for x in queue:
            near = [(v, e) for v, e in zip(c.out(x).tolist(), c.edges_of(x).tolist(), strict=True) if v not in seen]
            for i in rng.permutation(len(near))[: rng.geometric(1 - pf) - 1].tolist():
                v, e = near[i]
                seen.add(v)
                queue.append(v)
                burnt[e] += 1
                total += 1
        total += not len(queue) > 1  # fires that don't spread end too
    s = burnt / max(burnt.max(), 1)
    return frame(g, list(zip(c.ids[c.src].tolist(), c.ids[c.dst].tolist(), s[: c.m].tolist(), strict=True)), "src long, dst long, score double")


# sparsifiers: a score, and a parameter above which edges stay


def threshold(g: Graph, scores: DataFrame, value: float, above: bool = True) -> Graph:
    """Edges with a score of at least value (at most, if not above); all nodes stay."""
    keep = scores.where(F.col("score") >= value if above else F.col("score") <= value).select("src", "dst")
    return Graph(g.vertices, g.edges.join(keep, ["src", "dst"], "left_semi").select("src", "dst", "weight"), g.directed)


def simmelian_nonparametric(g: Graph, value: float) -> Graph:
    g = g.materialized()
    return threshold(g, prefix_jaccard(_triangles(g)), value)


def simmelian_parametric(g: Graph, max_rank: int, min_overlap: int) -> Graph:
    g = g.materialized()
    return threshold(g, simmelian_overlap(_triangles(g), max_rank), min_overlap)


def disparity(g: Graph, alpha: float) -> Graph:
    return threshold(g, S.disparity(g), alpha)


def triangle_disparity(g: Graph, alpha: float) -> Graph:
    """Disparity of triangle counts instead of weights."""
    g = g.materialized()
    t = as_weights(g, _triangles(g), offset=0.0)
    return threshold(g, S.disparity(t).fillna(0.0), alpha)


def by_local_similarity(g: Graph, value: float) -> Graph:
    return threshold(g, local_similarity(g), value)


def by_local_degree(g: Graph, value: float) -> Graph:
    return threshold(g, S.local_degree(g), value)


def by_scan(g: Graph, value: float) -> Graph:
    from graphloom.operators.similarity import edge_scores

    return threshold(g, edge_scores(g).select("src", "dst", F.col("scan").alias("score")), value)


def by_triangles(g: Graph, value: float) -> Graph:
    g = g.materialized()
    return threshold(g, _triangles(g), value)


def random_part(g: Graph, ratio: float, seed: int = 1) -> Graph:
    return threshold(g, random_edge(g, seed), 1 - ratio)


def random_node_edge_part(g: Graph, ratio: float, seed: int = 1) -> Graph:
    return threshold(g, random_node_edge(g, seed=seed), 1 - ratio)


def by_forest_fire(g: Graph, value: float, pf: float = 0.6, burn: float = 1.0, seed: int = 1) -> Graph:
    return threshold(g, forest_fire(g, pf, burn, seed), value)


def within_communities(g: Graph, p: DataFrame) -> Graph:
    """Edges inside communities."""
    c = lambda x, n: p.select(F.col("node").alias(x), F.col("community").alias(n))
    return Graph(g.vertices, g.edges.join(c("src", "a"), "src").join(c("dst", "b"), "dst").where("a = b").select("src", "dst", "weight"), g.directed)


def constant(g: Graph, value: float = 1.0) -> DataFrame:
    return g.edges.select("src", "dst", F.lit(value).alias("score"))


def partition_score(g: Graph, p: DataFrame) -> DataFrame:
    """1 for edges inside communities, else 0."""
    c = lambda x, n: p.select(F.col("node").alias(x), F.col("community").alias(n))
    return g.edges.select("src", "dst").join(c("src", "a"), "src").join(c("dst", "b"), "dst").select("src", "dst", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0).alias("score"))


def rank_score(scores: DataFrame) -> DataFrame:
    """Mean rank over the number of edges."""
    from graphloom.operators.toolbox import ranked

    m = scores.count()
    return ranked(scores.withColumnRenamed("score", "value")).select("src", "dst", (F.col("rank") / max(m, 1)).alias("score"))


def parameter_for_ratio(g: Graph, sparsify: Callable[[Graph, float], Graph], ratio: float, low: float = 0.0, high: float = 1.0, steps: int = 20) -> float:
    """By bisection, a parameter that keeps about ratio of the edges; sparsify must keep fewer as it rises."""
    m, best = g.edges.count(), None
    for _ in range(steps):
        mid = (low + high) / 2
        got = sparsify(g, mid).edges.count() / max(m, 1)
        if best is None or abs(got - ratio) < best[0]:
            best = (abs(got - ratio), mid)
        low, high = (mid, high) if got > ratio else (low, mid)
        if best[0] * m < 1:
            break
    return best[1]


def parameter_by_search(g: Graph, sparsify: Callable[[Graph, float], Graph], ratio: float, values: list[float]) -> float:
    """Of given parameters, the one whose share of edges is nearest to ratio; the first of equals."""
    m = g.edges.count()
    return min(values, key=lambda v: abs(sparsify(g, v).edges.count() / max(m, 1) - ratio))
