"""Matchings beyond the greedy one, independent sets, flow and planarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels.csr import collect, frame
from graphloom.plans.scratch import discard, materialize


def b_matching(g: Graph, b: DataFrame | int = 1) -> DataFrame:
    """(src, dst, weight): every node of at most b (node, b) partners. In each round nodes point to as many of their heaviest open edges as they have room for; edges pointed to from both ends are taken. Equal weights go by a hash of the ends, so that no chain of nodes waits for one another. For b = 1 a greedy matching."""
    room = g.vertices.select(F.col("id").alias("node"), F.lit(b).alias("b")) if isinstance(b, int) else b.select("node", "b")
    room = materialize(room, "room")
    left, done = materialize(g.edges.where("src <> dst").select("src", "dst", "weight"), "open"), None
    while not left.isEmpty():
        sides = left.select("src", "dst", "weight", F.explode(F.array("src", "dst")).alias("node")).join(room.where("b > 0"), "node")
        order = Window.partitionBy("node").orderBy(F.desc("weight"), F.xxhash64("src", "dst"), "src", "dst")
        want = sides.withColumn("r", F.row_number().over(order)).where("r <= b").groupBy("src", "dst", "weight").agg(F.count("*").alias("k")).where("k = 2")
        won = materialize(want.select("src", "dst", "weight"), "won")
        if won.isEmpty():
            break
        done = won if done is None else done.union(won)
        used = won.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
        new_room = materialize(room.join(used, "node", "left").select("node", (F.col("b") - F.coalesce("k", F.lit(0))).alias("b")), "room")
        open_ = new_room.where("b > 0").select("node")
        new = left.join(won, ["src", "dst"], "left_anti").join(open_.withColumnRenamed("node", "src"), "src", "left_semi").join(open_.withColumnRenamed("node", "dst"), "dst", "left_semi")
        new = materialize(new.select("src", "dst", "weight"), "open")
        discard(left, room)
        left, room = new, new_room
    return done if done is not None else g.edges.where("false").select("src", "dst", "weight")


def updated_b_matching(g: Graph, matching: DataFrame, changed: DataFrame, b: int = 1) -> DataFrame:
    """The b-matching after edges (src, dst) came or went, g being the new graph: components of g that they touch are matched anew, others keep theirs."""
    from graphloom.operators.iterative import connected_components

    c = materialize(connected_components(g), "comp")
    hit = changed.select(F.explode(F.array("src", "dst")).alias("node")).join(c, "node").select("component").distinct()
    open_ = materialize(c.join(hit, "component", "left_semi").select("node"), "open")
    part = Graph(open_.withColumnRenamed("node", "id"), g.edges.join(open_.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "weight"), g.directed)
    kept = matching.join(open_.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst", "weight")
    return kept.union(b_matching(part, b))


def path_growing(g: Graph) -> DataFrame:
    """(src, dst, weight): paths grow along the heaviest open edge, their edges fall in turn to two matchings, and the heavier one counts. On the driver."""
    c = collect(g)
    gone, two = np.zeros(c.n, dtype=bool), [[], []]
    for u in range(c.n):
        x, side = u, 0
        while not gone[x]:
            near = [(w, -v, v, e) for v, w, e in zip(c.out(x).tolist(), c.weights(x).tolist(), c.edges_of(x).tolist(), strict=True) if v != x and not gone[v]]
            gone[x] = True
            if not near:
                break
            _, _, v, e = max(near)
            two[side].append(e)
            side, x = 1 - side, v
    best = max(two, key=lambda t: c.weight[t].sum() if t else 0.0)
    return frame(g, [(c.ids[c.src[e]], c.ids[c.dst[e]], float(c.weight[e])) for e in sorted(best)], "src long, dst long, weight double")


def mates(matching: DataFrame) -> DataFrame:
    """(u, mate), both ways."""
    return matching.select(F.col("src").alias("u"), F.col("dst").alias("mate")).union(matching.select("dst", "src"))


def matching_report(g: Graph, matching: DataFrame, b: int = 1) -> DataFrame:
    """One row: proper (edges of g, no node in more than b), size, weight."""
    deg = mates(matching).groupBy("u").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("most"))
    odd = matching.join(g.edges, ["src", "dst"], "left_anti").agg(F.count("*").alias("odd"))
    t = matching.agg(F.count("*").alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    one = F.lit(1).alias("_k")
    r = deg.select("*", one).join(odd.select("*", one), "_k").join(t.select("*", one), "_k")
    return r.select(((F.col("most") <= b) & (F.col("odd") == 0)).alias("proper"), "size", "weight")


def independent_set(g: Graph, seed: int = 1) -> DataFrame:
    """(node): a maximal independent set. In each round nodes draw a number; those below all open neighbours' come in, they and their neighbours leave."""
    arcs, left, done, turn = materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "mis-e"), materialize(g.vertices.select("id"), "mis-v"), None, 0
    while not left.isEmpty():
        draw = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(seed), F.lit(t)).alias("h"), F.col(c).alias("i"))
        least = arcs.groupBy(F.col("u").alias("id")).agg(F.min(draw("v")).alias("m"))
        won = materialize(left.join(least, "id", "left").where(F.col("m").isNull() | (draw("id") < F.col("m"))).select("id"), "mis")
        done = won if done is None else done.union(won)
        out = won.union(arcs.join(won.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id"))).distinct()
        new_left = materialize(left.join(out, "id", "left_anti"), "mis-v")
        new_arcs = materialize(arcs.join(new_left.withColumnRenamed("id", "u"), "u", "left_semi").join(new_left.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v"), "mis-e")
        discard(left, arcs)
        left, arcs, turn = new_left, new_arcs, turn + 1
    return (done if done is not None else g.vertices.select("id")).select(F.col("id").alias("node"))


def is_independent(g: Graph, nodes: DataFrame) -> DataFrame:
    """One row: whether no edge but loops joins two of nodes (node)."""
    n = nodes.select("node").distinct()
    e = g.edges.where("src <> dst").join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return e.agg((F.count("*") == 0).alias("independent"))


def maximum_flow(g: Graph, source: int, sink: int) -> tuple[float, DataFrame, DataFrame]:
    """Value, (src, dst, flow), and (node) of the source's side of a minimum cut, by shortest augmenting paths. On the driver."""
    from graphloom.kernels.flow import max_flow

    c = collect(g)
    s, t = c.index([source, sink])
    value, flow, side = max_flow(c.n, c.src, c.dst, c.weight, s, t, g.directed)
    return value, frame(g, list(zip(c.ids[c.src].tolist(), c.ids[c.dst].tolist(), flow.tolist(), strict=True)), "src long, dst long, flow double"), frame(g, [(c.ids[u],) for u in side], "node long")


def is_planar(g: Graph) -> DataFrame:
    """One row: whether an undirected graph can be drawn without crossings. On the driver."""
    from graphloom.kernels.order import planar

    return frame(g, [(bool(planar(collect(g))),)], "planar boolean")


def maximal_cliques(g: Graph, largest_only: bool = False) -> DataFrame:
    """(clique), sorted nodes. A node without edges is one, and so is an edge without triangles; only the edges of triangles are gathered, and each larger clique is found from its first node in an order of degeneracy, nodes being dealt out."""
    from graphloom.operators.triangles import triangles_by_edge

    if g.directed:
        out = _cliques(g)
    else:
        h = Graph(g.vertices, g.edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"), F.lit(1.0).alias("weight")).distinct()).materialized()
        e = materialize(triangles_by_edge(h), "triangles")
        ends = lambda x: x.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        alone = g.vertices.select("id").distinct().join(ends(e), "id", "left_anti")
        out = alone.select(F.array("id").alias("clique")).union(e.where("triangles = 0").select(F.array("dst", "src")))
        dense = e.where("triangles > 0").select("src", "dst", F.lit(1.0).alias("weight"))
        if not dense.isEmpty():
            out = out.union(_cliques(Graph(materialize(ends(dense), "ends"), dense)))
    if not largest_only:
        return out
    out = materialize(out, "cliques")
    top = out.agg(F.max(F.size("clique"))).first()[0] or 0
    return out.where(F.size("clique") == top).orderBy("clique").limit(1)


def _cliques(g: Graph) -> DataFrame:
    from graphloom.kernels.csr import per_source
    from graphloom.kernels.order import cliques_from, degeneracy

    c = collect(g)
    rank = np.empty(c.n, dtype=np.int64)
    rank[degeneracy(c)] = np.arange(c.n)
    return per_source(g, None, lambda c, u: [(sorted(c.ids[q].tolist()),) for q in cliques_from(c, rank, u)], "clique array<long>", c)


def union_maximum_forest(g: Graph) -> DataFrame:
    """(src, dst, weight): edges in some maximum spanning forest: those whose ends no heavier edges join. Classes of equal weight are added one after another."""
    from graphloom.operators.iterative import spanning_forest
    from graphloom.operators.paths import merged_components

    forest = materialize(spanning_forest(g, largest=True), "msf")
    weights = [r[0] for r in forest.select("weight").distinct().orderBy(F.desc("weight")).collect()]
    comp = materialize(g.vertices.select(F.col("id").alias("node"), F.col("id").alias("component")), "comp")
    e, out = g.edges.where("src <> dst"), None
    for w in weights:
        c = lambda x, n, comp=comp: comp.select(F.col("node").alias(x), F.col("component").alias(n))
        new = materialize(e.where(F.col("weight") == w).join(c("src", "a"), "src").join(c("dst", "b"), "dst").where("a <> b").select("src", "dst", "weight"), "class")
        out = new if out is None else out.union(new)
        comp = materialize(merged_components(comp, new), "comp")
    return out if out is not None else e.where("false").select("src", "dst", "weight")
