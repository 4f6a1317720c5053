"""Quality and similarity of partitions(node, community)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.structure import degrees


def _of(p: DataFrame, node: str, name: str) -> DataFrame:
    return p.select(F.col("node").alias(node), F.col("community").alias(name))


def _labelled(g: Graph, p: DataFrame) -> DataFrame:
    return g.edges.join(_of(p, "src", "a"), "src").join(_of(p, "dst", "b"), "dst")


def community_sizes(p: DataFrame) -> DataFrame:
    return p.groupBy("community").agg(F.count("*").alias("size"))


def coverage(g: Graph, p: DataFrame) -> DataFrame:
    """One row: weight inside communities over all weight."""
    return _labelled(g, p).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("coverage"))


def edge_cut(g: Graph, p: DataFrame) -> DataFrame:
    return _labelled(g, p).where("a <> b").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("edge_cut"))


def modularity(g: Graph, p: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: coverage less gamma times the expected one; volumes count loops twice."""
    e = _labelled(g, p)
    inside = e.agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"))
    vol = e.select(F.explode(F.array("a", "b")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("v2"))
    return inside.join(F.broadcast(vol)).select((F.col("inner") / F.col("total") - gamma * F.col("v2") / (4 * F.col("total") * F.col("total"))).alias("modularity"))


def community_report(g: Graph, p: DataFrame) -> DataFrame:
    """Per community: size, inner weight, cut, volume, conductance = cut / min(volume, rest), expansion = cut / min(size, n - size)."""
    e = _labelled(g, p)
    total = e.agg((2 * F.sum("weight")).alias("all"))
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("community"), F.col("b").alias("o")), F.struct(F.col("b").alias("community"), F.col("a").alias("o")))).alias("x"), "weight").select("x.*", "weight")
    per = ends.groupBy("community").agg(F.sum("weight").alias("volume"), F.sum(F.when(F.col("o") != F.col("community"), F.col("weight")).otherwise(0.0)).alias("cut"))
    n = p.agg(F.count("*").alias("n"))
    out = community_sizes(p).join(per, "community", "left").fillna(0.0, ["volume", "cut"]).join(F.broadcast(total)).join(F.broadcast(n))
    small = F.least("volume", F.col("all") - F.col("volume"))
    few = F.least("size", F.col("n") - F.col("size"))
    return out.select("community", "size", ((F.col("volume") - F.col("cut")) / 2).alias("inner_weight"), "cut", "volume", F.when(small > 0, F.col("cut") / small).otherwise(1.0).alias("conductance"), F.when(few > 0, F.col("cut") / few).otherwise(0.0).alias("expansion"))


def imbalance(p: DataFrame) -> DataFrame:
    """One row: largest size over ceil(n / k)."""
    s = community_sizes(p)
    return s.agg((F.max("size") / F.ceil(F.sum("size") / F.count("*"))).alias("imbalance"))


def hub_dominance(g: Graph, p: DataFrame) -> DataFrame:
    """Per community: largest inner degree over size - 1; 1 for single nodes."""
    inner = _labelled(g, p).where("a = b AND src <> dst").select(F.explode(F.array("src", "dst")).alias("node"), F.col("a").alias("community")).groupBy("community", "node").agg(F.count("*").alias("d"))
    top = inner.groupBy("community").agg(F.max("d").alias("d"))
    return community_sizes(p).join(top, "community", "left").select("community", F.when(F.col("size") > 1, F.coalesce("d", F.lit(0)) / (F.col("size") - 1)).otherwise(1.0).alias("dominance"))


def coarsened(g: Graph, p: DataFrame) -> Graph:
    """Communities as nodes; weights add up, inner edges become loops."""
    e = _labelled(g, p).groupBy(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
    return Graph(p.select(F.col("community").alias("id")).distinct(), e, g.directed)


def compared(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: rand (share of pairs judged differently), jaccard dissimilarity, nmi distance, of two partitions of the same nodes."""
    both = _of(p, "node", "a").join(_of(q, "node", "b"), "node").groupBy("a", "b").agg(F.count("*").cast("double").alias("k"))
    pairs = lambda k: k * (k - 1) / 2
    x, y = (both.groupBy(c).agg(F.sum("k").alias("k")) for c in ("a", "b"))
    n = both.agg(F.sum("k").alias("n"), F.sum(pairs(F.col("k"))).alias("s11"))
    part = lambda t, s: t.agg(F.sum(pairs(F.col("k"))).alias(s), F.sum(F.col("k") * F.log2("k")).alias(s + "l"))
    mutual = both.agg(F.sum(F.col("k") * F.log2("k")).alias("kl"))
    r = n.join(F.broadcast(part(x, "sa"))).join(F.broadcast(part(y, "sb"))).join(F.broadcast(mutual))
    c = F.col
    ha, hb, hab = (F.log2("n") - c(k) / c("n") for k in ("sal", "sbl", "kl"))
    return r.select(
        ((c("sa") + c("sb") - 2 * c("s11")) / pairs(c("n"))).alias("rand"), (1 - c("s11") / (c("sa") + c("sb") - c("s11"))).alias("jaccard"),
        F.when(ha + hb > 0, 1 - 2 * (ha + hb - hab) / (ha + hb)).otherwise(0.0).alias("nmi_distance"),
    )


def weighted_degree_within(g: Graph, p: DataFrame) -> DataFrame:
    """(node, inside, outside): weight to a node's own community and to others."""
    a = g.arcs().where("u <> v").join(_of(p, "u", "a"), "u").join(_of(p, "v", "b"), "v")
    own = F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)
    s = a.groupBy(F.col("u").alias("node")).agg(F.sum(own).alias("inside"), F.sum(F.col("w") - own).alias("outside"))
    return p.select("node").join(s, "node", "left").fillna(0.0)


# partitions as tables


def members(p: DataFrame, community: int) -> DataFrame:
    return p.where(F.col("community") == community).select("node")


def moved(p: DataFrame, changes: DataFrame) -> DataFrame:
    """p with changes (node, community)."""
    return p.join(changes.select("node"), "node", "left_anti").select("node", "community").union(changes.select("node", "community"))


def merged(p: DataFrame, first: int, second: int) -> DataFrame:
    """p with two communities as one, named by the lesser."""
    low, high = min(first, second), max(first, second)
    return p.select("node", F.when(F.col("community") == high, F.lit(low)).otherwise(F.col("community")).alias("community"))


def compacted(p: DataFrame) -> DataFrame:
    """Communities renumbered from 0 in order of their names."""
    from graphloom.plans.numbering import numbered

    names = numbered(p.select("community").distinct(), "community", name="n")
    return p.join(names, "community").select("node", F.col("n").alias("community"))


def singletons(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("id").alias("node"), F.col("id").alias("community"))


def one_community(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("community"))


def random_partition(g: Graph, k: int, seed: int = 1) -> DataFrame:
    return g.vertices.select(F.col("id").alias("node"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).alias("community"))


def balanced_partition(g: Graph, k: int, continuous: bool = True) -> DataFrame:
    """k communities whose sizes differ by 1 at most: runs of ids, or ids in turn."""
    from graphloom.plans.numbering import numbered

    n = g.vertices.count()
    rows = numbered(g.vertices.select(F.col("id").alias("node")), "node", name="i")
    return rows.select("node", (F.floor(F.col("i") * k / max(n, 1)) if continuous else F.col("i") % k).cast("long").alias("community"))


def in_same_community(p: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, same) of pairs(u, v)."""
    return pairs.select("u", "v").join(_of(p, "u", "a"), "u").join(_of(p, "v", "b"), "v").select("u", "v", (F.col("a") == F.col("b")).alias("same"))


def partition_kind(g: Graph, p: DataFrame) -> DataFrame:
    """One row: proper (each node of g once and no other), singletons, one."""
    both = g.vertices.select(F.col("id").alias("node"), F.lit(1).alias("x")).join(p, "node", "full").groupBy("node").agg(F.count("community").alias("k"), F.max("x").alias("x"))
    proper = both.agg(F.coalesce(F.every(F.expr("k = 1 AND x IS NOT NULL")), F.lit(True)).alias("proper"))
    c = community_sizes(p).agg(F.count("*").alias("c"), F.sum("size").alias("n"))
    one = F.lit(1).alias("_k")
    return proper.select("*", one).join(c.select("*", one), "_k").select("proper", (F.coalesce("n", F.lit(0)) == F.col("c")).alias("singletons"), (F.col("c") == 1).alias("one"))


def equal_partitions(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: whether p and q part the same nodes alike, whatever the names."""
    both = p.withColumnRenamed("community", "a").join(q.withColumnRenamed("community", "b"), "node", "full")
    t = both.agg(F.count_distinct("a").alias("x"), F.count_distinct("b").alias("y"), F.count_distinct("a", "b").alias("xy"), F.count_if(F.expr("a IS NULL OR b IS NULL")).alias("odd"))
    return t.select(((F.col("odd") == 0) & (F.col("x") == F.col("xy")) & (F.col("y") == F.col("xy"))).alias("equal"))


def communication_graph(g: Graph, p: DataFrame) -> Graph:
    """Communities as nodes, with edges between different ones alone."""
    c = coarsened(g, p)
    return Graph(c.vertices, c.edges.where("src <> dst"), g.directed)


def matched_coarsening(g: Graph, matching: DataFrame, loops: bool = True) -> Graph:
    """Matched pairs (u, mate) contracted, named by the lesser; loops kept or not."""
    to = matching.select(F.greatest("u", "mate").alias("node"), F.least("u", "mate").alias("community")).where("node <> community")
    c = coarsened(g, moved(singletons(g), to))
    return c if loops else Graph(c.vertices, c.edges.where("src <> dst"), c.directed)


def projected(coarse: DataFrame, mapping: DataFrame) -> DataFrame:
    """(node, community) of fine nodes, from coarse (node, community) and mapping (node, coarse)."""
    return mapping.join(coarse.select(F.col("node").alias("coarse"), "community"), "coarse").select("node", "community")


def intersected(p: DataFrame, q: DataFrame) -> DataFrame:
    """The coarsest partition finer than both, communities named by their least node."""
    both = _of(p, "node", "a").join(_of(q, "node", "b"), "node")
    names = both.groupBy("a", "b").agg(F.min("node").alias("community"))
    return both.join(names, ["a", "b"]).select("node", "community")


# more measures


def adjusted_rand(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: 1 minus the adjusted Rand index."""
    both = _of(p, "node", "a").join(_of(q, "node", "b"), "node").groupBy("a", "b").agg(F.count("*").cast("double").alias("k"))
    two = lambda k: k * (k - 1) / 2
    one = F.lit(1).alias("_k")
    s = both.agg(F.sum(two(F.col("k"))).alias("s"), F.sum("k").alias("n"), one)
    a = both.groupBy("a").agg(F.sum("k").alias("k")).agg(F.sum(two(F.col("k"))).alias("x"), one)
    b = both.groupBy("b").agg(F.sum("k").alias("k")).agg(F.sum(two(F.col("k"))).alias("y"), one)
    r = s.join(a, "_k").join(b, "_k")
    expected, most = F.col("x") * F.col("y") / two(F.col("n")), (F.col("x") + F.col("y")) / 2
    return r.select(F.when(most != expected, 1 - (F.col("s") - expected) / (most - expected)).otherwise(0.0).alias("dissimilarity"))


def graph_rand(g: Graph, p: DataFrame, q: DataFrame, samples: int | None = None, seed: int = 1) -> DataFrame:
    """One row: share of edges (or of so many sampled ones) that p and q judge differently."""
    e = g.edges.select("src", "dst")
    if samples is not None:
        e = e.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(samples)
    e = e.join(_of(p, "src", "a"), "src").join(_of(p, "dst", "b"), "dst").join(_of(q, "src", "x"), "src").join(_of(q, "dst", "y"), "dst")
    return e.agg(F.avg(((F.col("a") == F.col("b")) != (F.col("x") == F.col("y"))).cast("double")).alias("dissimilarity"))


def sampled_rand(p: DataFrame, q: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """One row: share of sampled node pairs judged differently; pair i is drawn by a hash of i."""
    from graphloom.plans.numbering import numbered

    both = numbered(_of(p, "node", "a").join(_of(q, "node", "b"), "node"), "node", name="i")
    n = both.count()
    draw = lambda s: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), F.lit(max(n, 1)))
    pairs = p.sparkSession.range(samples).select(draw(1).alias("i"), draw(2).alias("j")).where("i <> j")
    left, right = both.select("i", "a", "b"), both.select(F.col("i").alias("j"), F.col("a").alias("x"), F.col("b").alias("y"))
    r = pairs.join(left, "i").join(right, "j")
    return r.agg(F.avg(((F.col("a") == F.col("x")) != (F.col("b") == F.col("y"))).cast("double")).alias("dissimilarity"))


def dynamic_nmi(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: NMI distance over the nodes of both; a node that only one has is a community of its own in the other."""
    both = _of(p, "node", "a").join(_of(q, "node", "b"), "node", "full")
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.concat(F.lit("n"), F.col("node").cast("string")))
    b = both.select("node", own("a").alias("a"), own("b").alias("b"))
    return compared(b.select("node", F.col("a").alias("community")), b.select("node", F.col("b").alias("community"))).select("nmi_distance")


def intrapartition_density(g: Graph, p: DataFrame) -> DataFrame:
    """Per community: inner edges over pairs of members; 1 for single nodes."""
    inner = _labelled(g, p).where("a = b AND src <> dst").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("m"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return community_sizes(p).join(inner, "community", "left").select("community", F.when(F.col("size") > 1, F.coalesce("m", F.lit(0)) / pairs).otherwise(1.0).alias("density"))


def partition_fragmentation(g: Graph, p: DataFrame) -> DataFrame:
    """Per community: 1 minus its largest part within one component of the graph, over its size."""
    from graphloom.operators.iterative import connected_components

    c = p.join(connected_components(g), "node").groupBy("community", "component").agg(F.count("*").alias("k"))
    return c.groupBy("community").agg((1 - F.max("k") / F.sum("k")).alias("fragmentation"))


def stable_nodes(g: Graph, p: DataFrame) -> DataFrame:
    """(node, stable): more weight to the own community than to any other; isolated nodes are stable."""
    a = g.arcs().where("u <> v").join(_of(p, "u", "a"), "u").join(_of(p, "v", "b"), "v").groupBy("u", "a", "b").agg(F.sum("w").alias("w"))
    s = a.groupBy(F.col("u").alias("node")).agg(F.coalesce(F.max(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0)).alias("own"), F.max(F.when(F.col("a") != F.col("b"), F.col("w"))).alias("other"))
    return p.select("node").join(s, "node", "left").select("node", F.coalesce(F.col("other").isNull() | (F.col("own") > F.col("other")), F.lit(True)).alias("stable"))


def evaluated(values: DataFrame, p: DataFrame, column: str) -> DataFrame:
    """One row of values (community, column): mean weighted by size, plain mean, least and largest."""
    v = community_sizes(p).join(values.select("community", F.col(column).alias("x")), "community")
    return v.agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("weighted"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("largest"))


# covers: (node, community) with a row for each community of a node


def cover_of(p: DataFrame) -> DataFrame:
    return p.select("node", "community").distinct()


def communities_of(cover: DataFrame) -> DataFrame:
    """(node, communities), sorted."""
    return cover.groupBy("node").agg(F.sort_array(F.collect_set("community")).alias("communities"))


def added_to(cover: DataFrame, more: DataFrame) -> DataFrame:
    return cover.select("node", "community").union(more.select("node", "community")).distinct()


def removed_from(cover: DataFrame, less: DataFrame) -> DataFrame:
    return cover.join(less.select("node", "community"), ["node", "community"], "left_anti")


def moved_to(cover: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes of changes (node, community) leave all communities for that one."""
    return cover.join(changes.select("node"), "node", "left_anti").select("node", "community").union(changes.select("node", "community"))


def cover_hub_dominance(g: Graph, cover: DataFrame) -> DataFrame:
    """Per community: largest inner degree over size - 1; 1 for single nodes."""
    c = lambda x, n: cover.select(F.col("node").alias(x), F.col("community").alias(n))
    e = g.edges.where("src <> dst").join(c("src", "community"), "src").join(c("dst", "b"), "dst").where("community = b")
    d = e.select("community", F.explode(F.array("src", "dst")).alias("node")).groupBy("community", "node").agg(F.count("*").alias("d")).groupBy("community").agg(F.max("d").alias("d"))
    return community_sizes(cover).join(d, "community", "left").select("community", F.when(F.col("size") > 1, F.coalesce("d", F.lit(0)) / (F.col("size") - 1)).otherwise(1.0).alias("dominance"))


def _overlaps(cover: DataFrame, other: DataFrame) -> DataFrame:
    both = cover.select("node", F.col("community").alias("a")).join(other.select("node", F.col("community").alias("b")), "node").groupBy("a", "b").agg(F.count("*").alias("k"))
    x, y = community_sizes(cover).select(F.col("community").alias("a"), F.col("size").alias("x")), community_sizes(other).select(F.col("community").alias("b"), F.col("size").alias("y"))
    return both.join(x, "a").join(y, "b")


def cover_f1(cover: DataFrame, reference: DataFrame) -> DataFrame:
    """Per community: the best F1 against a reference community."""
    f1 = _overlaps(cover, reference).groupBy(F.col("a").alias("community")).agg(F.max(2 * F.col("k") / (F.col("x") + F.col("y"))).alias("f1"))
    return community_sizes(cover).join(f1, "community", "left").select("community", F.coalesce("f1", F.lit(0.0)).alias("f1"))


def overlapping_nmi(cover: DataFrame, other: DataFrame, normalization: str = "max") -> DataFrame:
    """One row: 1 minus the mutual information of two covers over min, max, arithmetic or geometric mean or joint entropy.

    A community of one side is explained by the one of the other that leaves least of its entropy, if
    that says more than chance; without one nothing is explained.
    """
    n = cover.select("node").union(other.select("node")).distinct().count()
    h = lambda k: F.when(k > 0, -k / n * F.log2(k / n)).otherwise(0.0)
    c = F.col
    one = F.lit(1).alias("_k")

    def side(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        o = _overlaps(a, b)
        d11, d10, d01 = c("k"), c("x") - c("k"), c("y") - c("k")
        d00 = F.lit(n) - c("x") - c("y") + c("k")
        sure = h(d11) + h(d00) >= h(d01) + h(d10)
        rest = h(d11) + h(d10) + h(d01) + h(d00) - h(c("y")) - h(F.lit(n) - c("y"))
        best = o.where(sure).withColumn("rest", rest).groupBy("a").agg(F.min("rest").alias("rest"))
        s = community_sizes(a).select(F.col("community").alias("a"), (h(c("size")) + h(F.lit(n) - c("size"))).alias("h")).join(best, "a", "left")
        return s.agg(F.sum("h").alias("h" + name), F.sum(F.least("h", F.coalesce("rest", "h"))).alias("r" + name), one)

    t = side(cover, other, "x").join(side(other, cover, "y"), "_k")
    mutual = (c("hx") - c("rx") + c("hy") - c("ry")) / 2
    by = {"min": F.least("hx", "hy"), "max": F.greatest("hx", "hy"), "arithmetic": (c("hx") + c("hy")) / 2, "geometric": F.sqrt(c("hx") * c("hy")), "joint": (c("hx") + c("ry") + c("hy") + c("rx")) / 2}[normalization]
    return t.select(F.when(by > 0, 1 - mutual / by).otherwise(F.when(c("hx") == c("hy"), 0.0).otherwise(1.0)).alias("distance"))
