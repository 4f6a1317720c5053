"""Operators that loop: each round is one relational step, written to the shared folder so lineage stays short."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels.products import Products
from graphloom.operators.components import star_components
from graphloom.operators.structure import degrees
from graphloom.plans.scratch import discard, materialize


def _step(state: DataFrame, new: DataFrame, name: str) -> DataFrame:
    out = materialize(new, name)
    discard(state)
    return out


def _as(written: DataFrame, view: DataFrame) -> DataFrame:
    """view, to be discarded with the table it reads."""
    view._scratch_path = written._scratch_path
    return view


def pagerank(g: Graph, damping: float = 0.85, iterations: int = 100, tol: float = 1e-9, distribute_sinks: bool = False) -> DataFrame:
    """(node, score): starts at 1/n; stops where the sum of changes is at most tol. Without sink distribution, directed scores are scaled to sum 1."""
    g = g.materialized()
    n = g.vertices.count()
    if not n:
        return g.vertices.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    out = g.arcs().groupBy("u").agg(F.sum("w").alias("total"))
    along = Products(g)
    first = g.vertices.join(out.withColumnRenamed("u", "id"), "id", "left").select("id", F.lit(1.0 / n).alias("x"), F.coalesce("total", F.lit(0.0)).alias("total"), F.col("total").isNull().cast("double").alias("sink"))
    state = along.vector(first, "x", "total", "sink")

    def share(t: dict) -> np.ndarray:
        return np.divide(t["x"], t["total"], out=np.zeros(len(t["x"])), where=t["total"] != 0)

    for _ in range(iterations):
        base = (1 - damping) / n
        if distribute_sinks and g.directed:
            base += damping / n * (state.select(F.explode(F.arrays_zip("x", "sink")).alias("z")).agg(F.sum(F.col("z.x") * F.col("z.sink"))).first()[0] or 0.0)
        state = _next(state, along.step(state, ("x", "total", "sink"), share, lambda s, t, base=base: {"x": base + damping * s}))
        if state.agg(F.sum("change")).first()[0] <= tol:
            break
    along.close()
    state = along.values(state, "x")
    if g.directed and not distribute_sinks:
        total = state.agg(F.sum("x")).first()[0]
        return state.select(F.col("id").alias("node"), (F.col("x") / total).alias("score"))
    return state.select(F.col("id").alias("node"), F.col("x").alias("score"))


def _next(state: DataFrame, new: DataFrame) -> DataFrame:
    discard(state)
    return new


def eigenvector(g: Graph, iterations: int = 100, tol: float = 1e-9) -> DataFrame:
    """(node, score) by power iteration over in-arcs, scaled to length 1 each round until the length settles."""
    g = g.materialized()
    along, length, scale = Products(g), None, 1.0
    state = along.vector(g.vertices.select("id", F.lit(1.0).alias("x")), "x")
    for _ in range(iterations):
        # what is sent is scaled, by the length of the round before
        state = _next(state, along.step(state, ("x",), lambda t, scale=scale: t["x"] / scale, lambda s, t: {"x": s}))
        size = (state.agg(F.sum("square")).first()[0] or 0.0) ** 0.5
        scale = size or 1.0
        if length is not None and abs(size - length) <= tol:
            break
        length = size
    along.close()
    return along.values(state, "x").select(F.col("id").alias("node"), (F.col("x") / scale).alias("score"))


def katz(g: Graph, alpha: float | None = None, beta: float = 0.1, iterations: int = 100, tol: float = 1e-9) -> DataFrame:
    """x = beta + alpha * sum of w (1 + x) over in-arcs, unscaled between rounds; the result has length 1."""
    g = g.materialized()
    a = alpha if alpha is not None else 1.0 / (1 + (degrees(g).agg(F.max("degree")).first()[0] or 0))
    along, length, size = Products(g), None, None
    state = along.vector(g.vertices.select("id", F.lit(1.0).alias("x")), "x")
    for _ in range(iterations):
        state = _next(state, along.step(state, ("x",), lambda t: a * (1 + t["x"]), lambda s, t: {"x": beta + s}))
        size = (state.agg(F.sum("square")).first()[0] or 0.0) ** 0.5
        if length is not None and abs(size - length) <= tol * max(size, 1.0):
            break
        length = size
    along.close()
    return along.values(state, "x").select(F.col("id").alias("node"), (F.col("x") / (size or 1.0)).alias("score"))


def bfs(g: Graph, sources: DataFrame) -> DataFrame:
    """(node, distance, paths): hops from the nearest of sources(id), and shortest paths by which they are reached; reached nodes only."""
    arcs = materialize(g.arcs().select("u", "v"), "arcs")
    front = materialize(sources.join(g.vertices, "id", "left_semi").distinct().select(F.col("id").alias("node"), F.lit(0).alias("distance"), F.lit(1.0).alias("paths")), "bfs")
    levels, hop = [front], 0
    while not front.isEmpty():
        hop += 1
        reach = arcs.join(front.select(F.col("node").alias("u"), "paths"), "u").groupBy(F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        known = reduce(DataFrame.union, [x.select("node") for x in (levels if g.directed else levels[-2:])])  # an undirected edge leads back by one level at most
        front = materialize(reach.join(known, "node", "left_anti").select("node", F.lit(hop).alias("distance"), "paths"), "front")
        levels.append(front)
        if g.directed and len(levels) >= 16:  # one table of what is known in place of many
            levels = [materialize(reduce(DataFrame.union, levels), "bfs"), front.where("false")]
    discard(arcs)
    return reduce(DataFrame.union, levels)


def shortest_paths(g: Graph, sources: DataFrame) -> DataFrame:
    """(node, distance): least weight from sources(id), weights not negative; a round relaxes the nodes that changed."""
    arcs = materialize(g.arcs(), "arcs")
    best = changed = materialize(sources.join(g.vertices, "id", "left_semi").distinct().select(F.col("id").alias("node"), F.lit(0.0).alias("distance")), "sssp")
    while not changed.isEmpty():
        before, old = best, changed
        offer = arcs.join(changed.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        better = offer.join(best, "node", "left").where("distance IS NULL OR offer < distance")
        changed = materialize(better.select("node", F.col("offer").alias("distance")), "changed")
        best = materialize(best.join(changed.select("node"), "node", "left_anti").union(changed), "sssp")
        discard(before, old)
    return best


def connected_components(g: Graph) -> DataFrame:
    """(node, component): weak components named by their least node."""
    c = star_components(g.edges)
    return g.vertices.withColumnRenamed("id", "node").join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def strongly_connected_components(g: Graph) -> DataFrame:
    """(node, component) by forward and backward least labels: a node whose label comes back to it names its component; those leave, round by round."""
    left, arcs, done = materialize(g.vertices, "scc-v"), materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "scc-e"), None

    def least(arcs: DataFrame, init: DataFrame, within: str | None) -> DataFrame:
        state = materialize(init, "label")
        while True:
            sent = arcs.join(state.withColumnRenamed("id", "u"), "u")
            if within:
                sent = sent.join(state.select(F.col("id").alias("v"), F.col(within).alias("own")), "v").where(f"own = {within}")
            got = sent.groupBy(F.col("v").alias("id")).agg(F.min("x").alias("y"))
            new = materialize(state.join(got, "id", "left").withColumn("z", F.least("x", F.coalesce("y", "x"))).drop("y"), "label")
            moved = new.where("z < x").isEmpty()
            state2 = new.drop("x").withColumnRenamed("z", "x")
            if moved:
                return state2
            state = state2

    while not left.isEmpty():
        while True:  # nodes without an arc in or out are components of their own: chains go by ends, without labels
            both = arcs.select(F.col("u").alias("id")).distinct().intersect(arcs.select(F.col("v").alias("id")).distinct())
            alone = materialize(left.join(both, "id", "left_anti"), "scc-1")
            if alone.isEmpty():
                break
            single = alone.select(F.col("id").alias("node"), F.col("id").alias("component"))
            done = single if done is None else done.union(single)
            left = materialize(left.join(alone, "id", "left_anti"), "scc-v")
            arcs = materialize(arcs.join(left.select(F.col("id").alias("u")), "u", "left_semi").join(left.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v"), "scc-e")
        if left.isEmpty():
            break
        forward = materialize(least(arcs, left.select("id", F.col("id").alias("x")), None), "fw")
        tagged = forward.select("id", F.col("x").alias("f"), F.when(F.col("x") == F.col("id"), F.col("id")).otherwise(F.lit((1 << 63) - 1)).alias("x"))
        back = least(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")), tagged, "f")
        found = materialize(back.where("x = f").select(F.col("id").alias("node"), F.col("f").alias("component")), "scc")
        done = found if done is None else done.union(found)
        left = materialize(left.join(found.select(F.col("node").alias("id")), "id", "left_anti"), "scc-v")
        arcs = materialize(arcs.join(left.select(F.col("id").alias("u")), "u", "left_semi").join(left.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v"), "scc-e")
    # a component is named by the least node that reaches it among those left, which lies in it
    return done if done is not None else g.vertices.select(F.col("id").alias("node"), F.col("id").alias("component"))


def core_numbers(g: Graph) -> DataFrame:
    """(node, core) by rounds in which a node takes the h-index of its neighbours' values, which settles at the core number."""
    arcs = materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "core-e")
    d = arcs.groupBy("u").count()
    state = materialize(g.vertices.join(d.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("x")), "core")
    while True:
        vals = arcs.join(state.select(F.col("id").alias("v"), "x"), "v").groupBy(F.col("u").alias("id"), "x").agg(F.count("*").alias("k"))
        at_least = F.sum("k").over(Window.partitionBy("id").orderBy(F.desc("x")))
        h = vals.withColumn("c", at_least).groupBy("id").agg(F.max(F.least("c", "x")).alias("h"))
        new = materialize(state.join(h, "id", "left").select("id", F.coalesce("h", F.lit(0)).alias("y"), "x"), "core")
        if new.where("y <> x").isEmpty():
            return new.select(F.col("id").alias("node"), F.col("x").alias("core"))
        discard(state)
        state = _as(new, new.select("id", F.col("y").alias("x")))


def label_propagation(g: Graph, rounds: int = 20) -> DataFrame:
    """(node, community): synchronous; a node takes the heaviest label around it, its own counting first among equals, then the least."""
    arcs = materialize(g.arcs().where("u <> v"), "lp-e")
    state = materialize(g.vertices.select("id", F.col("id").alias("x")), "lp")
    for r in range(rounds):
        votes = arcs.join(state.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id"), "x").agg(F.sum("w").alias("k"))
        best = votes.groupBy("id").agg(F.max(F.struct("k", (-F.col("x")).alias("m"))).alias("b"), F.max("k").alias("top"))
        own = votes.withColumnRenamed("x", "own").withColumnRenamed("k", "mine")
        new = state.join(best, "id", "left").join(own, (state["id"] == own["id"]) & (state["x"] == own["own"]), "left").select(state["id"], "x", F.when((F.col("mine") >= F.col("top")) | F.col("b").isNull(), F.col("x")).otherwise(-F.col("b.m")).alias("y"))
        # every other node moves in a round, by turns, so that two nodes don't swap labels for ever
        new = materialize(new.select("id", "x", F.when(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0, F.col("y")).otherwise(F.col("x")).alias("z"), "y"), "lp")
        settled = new.where("y <> x").isEmpty()
        discard(state)
        state = _as(new, new.select("id", F.col("z").alias("x")))
        if settled:
            break
    return state.select(F.col("id").alias("node"), F.col("x").alias("community"))


def spanning_forest(g: Graph, largest: bool = False) -> DataFrame:
    """(src, dst, weight) of a minimum (maximum) spanning forest: Borůvka rounds; ties go to the least (src, dst)."""
    sign = -1.0 if largest else 1.0
    e = materialize(g.edges.where("src <> dst").select("src", "dst", "weight", F.struct((sign * F.col("weight")).alias("k"), F.col("src").alias("s"), F.col("dst").alias("d")).alias("key")), "msf-e")
    comp = materialize(g.vertices.select(F.col("id").alias("node"), F.col("id").alias("c")), "msf")
    forest: DataFrame | None = None
    while True:
        out = e.join(comp.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(comp.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").where("a <> b")
        pick = out.select("key", "weight", F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.min(F.struct("key", "weight")).alias("m"))
        chosen = materialize(pick.select("m.key.s", "m.key.d", "m.weight").distinct().select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight"), "msf-c")
        if chosen.isEmpty():
            return forest if forest is not None else g.edges.where("false").select("src", "dst", "weight")
        forest = chosen if forest is None else materialize(forest.union(chosen), "msf-f")
        comp = materialize(connected_components(Graph(g.vertices, forest)).withColumnRenamed("component", "c"), "msf")


def greedy_matching(g: Graph) -> DataFrame:
    """(src, dst, weight): the matching that takes heaviest edges first (ties: least src, then dst), found by locally dominant edges round by round."""
    left = materialize(g.edges.where("src <> dst").select("src", "dst", "weight", F.struct("weight", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d")).alias("key")), "match")
    done: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select("key", F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.max("key").alias("top"))
        t = lambda c, k: ends.select(F.col("n").alias(c), F.col("top").alias(k))
        won = materialize(left.join(t("src", "x"), "src").join(t("dst", "y"), "dst").where("key = x AND key = y").select("src", "dst", "weight"), "won")
        done = won if done is None else done.union(won)
        used = won.select(F.explode(F.array("src", "dst")).alias("n"))
        left = materialize(left.join(used.withColumnRenamed("n", "src"), "src", "left_anti").join(used.withColumnRenamed("n", "dst"), "dst", "left_anti").select("src", "dst", "weight", "key"), "match")
    return done if done is not None else g.edges.where("false").select("src", "dst", "weight")
