"""Small graph operations: lookups, edits, numbering, subgraphs, samples, order and attributes. A graph never changes; each edit gives a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.iterative import bfs
from graphloom.operators.structure import degrees
from graphloom.plans.numbering import numbered
from graphloom.plans.scratch import discard, materialize


def _oriented(g: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) as g stores its edges."""
    if g.directed:
        return pairs
    return pairs.withColumns({"src": F.greatest("src", "dst"), "dst": F.least("src", "dst")})


def _with(g: Graph, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
    return Graph(vertices if vertices is not None else g.vertices, edges.select("src", "dst", "weight"), g.directed)


# lookups


def upper_node_id_bound(g: Graph) -> DataFrame:
    """One row: the largest id plus 1, 0 without nodes."""
    return g.vertices.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("bound"))


def has_nodes(g: Graph, nodes: DataFrame) -> DataFrame:
    """(id, present) of nodes(id)."""
    known = g.vertices.select("id", F.lit(True).alias("present"))
    return nodes.select("id").join(known, "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))


def edge_weights(g: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v, present, weight) of pairs(u, v): whether there is an edge, and its weight (0 for none)."""
    asked = _oriented(g, pairs.select("u", "v", F.col("u").alias("src"), F.col("v").alias("dst")))
    w = g.edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    return asked.join(w, ["src", "dst"], "left").select("u", "v", F.col("w").isNotNull().alias("present"), F.coalesce("w", F.lit(0.0)).alias("weight"))


def ith_neighbours(g: Graph, asked: DataFrame) -> DataFrame:
    """(u, i, neighbour, weight) of asked(u, i): the i-th neighbour, from 0, in order of ids; null beyond the last."""
    adj = g.adjacency().withColumnRenamed("src", "u")
    at = F.col("i") + 1
    return asked.select("u", "i").join(adj, "u", "left").select("u", "i", F.try_element_at("nbrs", at.cast("int")).alias("neighbour"), F.try_element_at("ws", at.cast("int")).alias("weight"))


def parallel_edges(g: Graph) -> DataFrame:
    """(src, dst, copies) of edges that are there more than once; no rows for a simple graph."""
    return g.edges.groupBy("src", "dst").agg(F.count("*").alias("copies")).where("copies > 1")


def indexed_edges(g: Graph) -> DataFrame:
    """(src, dst, weight, eid): edges numbered from 0 in order of (src, dst)."""
    return numbered(g.edges.select("src", "dst", "weight"), "src", "dst", "weight", name="eid")


def max_degrees(g: Graph) -> DataFrame:
    """One row: max_degree, max_in_degree, max_weighted_degree, max_weighted_in_degree."""
    side = lambda c: g.edges.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("d"), F.sum("weight").alias("w")).agg(F.max("d").alias("d"), F.max("w").alias("w"))
    if not g.directed:
        d = degrees(g).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.max("weighted_degree"), F.lit(0.0)).alias("max_weighted_degree"))
        return d.select("max_degree", F.col("max_degree").alias("max_in_degree"), "max_weighted_degree", F.col("max_weighted_degree").alias("max_weighted_in_degree"))
    one = F.lit(1).alias("_k")  # both sides are single rows
    out, into = side("src").select("d", "w", one), side("dst").select(F.col("d").alias("x"), F.col("w").alias("y"), one)
    zero = lambda c, z, n: F.coalesce(c, F.lit(z)).alias(n)
    return out.join(into, "_k").select(zero("d", 0, "max_degree"), zero("x", 0, "max_in_degree"), zero("w", 0.0, "max_weighted_degree"), zero("y", 0.0, "max_weighted_in_degree"))


def volume(g: Graph, nodes: DataFrame | None = None, incoming: bool = False) -> DataFrame:
    """One row: the weighted degrees of nodes(id), all by default, added up; loops of undirected graphs count twice."""
    e = g.edges
    if g.directed:
        ends = e.select(F.col("dst" if incoming else "src").alias("id"), "weight")
    else:
        ends = e.select(F.col("src").alias("id"), "weight").union(e.select("dst", "weight"))
    if nodes is not None:
        ends = ends.join(nodes.select("id").distinct(), "id", "left_semi")
    return ends.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("volume"))


def weighted_degrees(g: Graph, loops_twice: bool = False, incoming: bool = False) -> DataFrame:
    """(node, weighted_degree); loops count twice on request."""
    e = g.edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.col("weight").alias("w")) if g.directed and incoming else g.arcs()
    w = F.when(F.col("u") == F.col("v"), F.col("w") * (2.0 if loops_twice else 1.0)).otherwise(F.col("w"))
    s = e.groupBy(F.col("u").alias("node")).agg(F.sum(w).alias("s"))
    return g.vertices.withColumnRenamed("id", "node").join(s, "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("weighted_degree"))


# edits


def add_nodes(g: Graph, nodes: DataFrame) -> Graph:
    """g with nodes(id); those it has stay once. Restores removed nodes too."""
    return Graph(g.vertices.select("id").union(nodes.select(F.col("id").cast("long"))).distinct(), g.edges, g.directed)


def remove_nodes(g: Graph, nodes: DataFrame) -> Graph:
    """g without nodes(id) and their edges."""
    n = nodes.select("id").distinct()
    e = g.edges.join(n.withColumnRenamed("id", "src"), "src", "left_anti").join(n.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return _with(g, e, g.vertices.join(n, "id", "left_anti"))


def add_edges(g: Graph, edges: DataFrame, check: bool = False) -> Graph:
    """g with edges(src, dst, weight); with check, pairs that have an edge are left out."""
    new = _oriented(g, edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    if check:
        new = new.groupBy("src", "dst").agg(F.min("weight").alias("weight")).join(g.edges, ["src", "dst"], "left_anti")
    ends = new.select(F.col("src").alias("id")).union(new.select("dst"))
    return _with(g, g.edges.select("src", "dst", "weight").union(new.select("src", "dst", "weight")), add_nodes(g, ends).vertices)


def remove_edges(g: Graph, pairs: DataFrame) -> Graph:
    """g without the edges of pairs (src, dst)."""
    return _with(g, g.edges.join(_oriented(g, pairs.select("src", "dst")), ["src", "dst"], "left_anti"))


def remove_all_edges(g: Graph) -> Graph:
    return _with(g, g.edges.where("false"))


def remove_adjacent_edges(g: Graph, nodes: DataFrame, condition: str = "true") -> Graph:
    """g without those edges at nodes(id) that meet an SQL condition on src, dst and weight."""
    n = nodes.select("id").distinct().withColumn("_in", F.lit(True))
    e = g.edges.join(n.withColumnRenamed("id", "src"), "src", "left").withColumnRenamed("_in", "_a").join(n.withColumnRenamed("id", "dst"), "dst", "left")
    return _with(g, e.where(~(F.coalesce(F.col("_a"), F.col("_in"), F.lit(False)) & F.expr(condition))))


def remove_edges_from_isolated_set(g: Graph, nodes: DataFrame) -> Graph:
    """g without all edges that start in nodes(id), a set from which no edge leads out."""
    return _with(g, g.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti"))


def remove_self_loops(g: Graph) -> Graph:
    return _with(g, g.edges.where("src <> dst"))


def remove_multi_edges(g: Graph) -> Graph:
    """One edge of each pair stays, the one of the least weight."""
    return _with(g, g.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))


def swap_edges(g: Graph, swaps: DataFrame) -> Graph:
    """swaps (s1, t1, s2, t2): edges s1-t1 and s2-t2 become s1-t2 and s2-t1 with their weights; both must exist, and no edge be in two swaps."""
    at = swaps.select(F.explode(F.array(F.struct(F.col("s1").alias("src"), F.col("t1").alias("dst"), F.col("t2").alias("to")), F.struct(F.col("s2").alias("src"), F.col("t2").alias("dst"), F.col("t1").alias("to")))).alias("x")).select("x.*")
    keyed = _oriented(g, at.withColumn("from", F.col("src")))
    hit = g.edges.join(keyed, ["src", "dst"])
    new = _oriented(g, hit.select(F.col("from").alias("src"), F.col("to").alias("dst"), "weight"))
    return _with(g, g.edges.join(keyed, ["src", "dst"], "left_anti").select("src", "dst", "weight").union(new))


def set_weights(g: Graph, weights: DataFrame, increase: bool = False) -> Graph:
    """g with weights (src, dst, weight) set, or added to what is there; absent edges are added."""
    new = _oriented(g, weights.select("src", "dst", F.col("weight").cast("double").alias("_new")))
    both = g.edges.join(new, ["src", "dst"], "full")
    w = F.coalesce("weight", F.lit(0.0)) + F.coalesce("_new", F.lit(0.0)) if increase else F.coalesce("_new", "weight")
    ends = new.select(F.col("src").alias("id")).union(new.select("dst"))
    return _with(g, both.select("src", "dst", w.alias("weight")), add_nodes(g, ends).vertices)


def unweighted(g: Graph) -> Graph:
    return _with(g, g.edges.withColumn("weight", F.lit(1.0)))


def randomized_weights(g: Graph, seed: int = 1) -> Graph:
    """Weights uniform in (0, 1), by a hash of each edge, so the same seed gives the same ones."""
    r = (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return _with(g, g.edges.withColumn("weight", r))


def sorted_edges(g: Graph, descending: bool = False) -> DataFrame:
    """Edges by weight, ties by (src, dst)."""
    return g.edges.orderBy(F.desc("weight") if descending else "weight", "src", "dst")


def from_csr(spark, indices: list[int], indptr: list[int], weights: list[float] | None = None, directed: bool = False) -> Graph:
    """A graph of rows: row u has the neighbours indices[indptr[u]:indptr[u + 1]]. Undirected rows list each edge twice."""
    import numpy as np
    import pyarrow as pa

    n = len(indptr) - 1
    if n < 0 or indptr[0] != 0 or indptr[-1] != len(indices) or any(a > b for a, b in zip(indptr, indptr[1:], strict=False)) or any(not 0 <= x < n for x in indices):
        raise ValueError("indptr must rise from 0 to the number of indices, which name rows")
    u = np.repeat(np.arange(n), np.diff(indptr))
    t = pa.table({"src": pa.array(u, pa.int64()), "dst": pa.array(indices, pa.int64()), "weight": pa.array(weights if weights is not None else np.ones(len(indices)), pa.float64())})
    e = spark.createDataFrame(t)
    return Graph(spark.range(n), e if directed else e.where("src >= dst"), directed)


# subgraphs and combinations


def copy_nodes(g: Graph) -> Graph:
    return remove_all_edges(g)


def subgraph_and_neighbours(g: Graph, nodes: DataFrame, outgoing: bool = True, incoming: bool = False) -> Graph:
    """Edges that touch nodes(id) and stay within them and their neighbours of the chosen kinds."""
    n = nodes.select("id").distinct()
    out = g.arcs().join(n.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id"))
    into = g.arcs().join(n.withColumnRenamed("id", "v"), "v", "left_semi").select(F.col("u").alias("id"))
    known = n.union(out) if outgoing else n
    known = (known.union(into) if incoming else known).distinct()
    e = g.edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    mark = n.withColumn("_in", F.lit(True))
    e = e.join(mark.withColumnRenamed("id", "src"), "src", "left").withColumnRenamed("_in", "_a").join(mark.withColumnRenamed("id", "dst"), "dst", "left")
    return _with(g, e.where("_a OR _in"), g.vertices.join(known, "id", "left_semi"))


def append(g: Graph, other: Graph) -> Graph:
    """Both graphs side by side; ids of the second move up by the first's bound."""
    bound = upper_node_id_bound(g).first()["bound"]
    up = other.edges.select((F.col("src") + bound).alias("src"), (F.col("dst") + bound).alias("dst"), "weight")
    return _with(g, g.edges.select("src", "dst", "weight").union(up), g.vertices.select("id").union(other.vertices.select((F.col("id") + bound).alias("id"))))


def augmented(g: Graph) -> Graph:
    """g with one more node, the next id, linked to all others."""
    root = upper_node_id_bound(g).first()["bound"]
    new = g.vertices.select(F.lit(root).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    return _with(g, g.edges.select("src", "dst", "weight").union(new), g.vertices.select("id").union(g.vertices.sparkSession.range(root, root + 1)))


# numbering


def continuous_ids(g: Graph, seed: int | None = None) -> DataFrame:
    """(id, number): nodes numbered from 0 by id, or at random."""
    v = g.vertices.select("id")
    return numbered(v, "id") if seed is None else numbered(v, F.xxhash64("id", F.lit(seed)), "id")


def remapped(g: Graph, ids: DataFrame) -> Graph:
    """g with each id replaced by its number in ids (id, number)."""
    t = lambda c: ids.select(F.col("id").alias(c), F.col("number").alias("n" + c))
    e = g.edges.join(t("src"), "src").join(t("dst"), "dst").select(F.col("nsrc").alias("src"), F.col("ndst").alias("dst"), "weight")
    return _with(g, _oriented(g, e), g.vertices.join(ids, "id").select(F.col("number").alias("id")))


def compacted(g: Graph) -> Graph:
    return remapped(g, continuous_ids(g))


def restored(g: Graph, ids: DataFrame) -> Graph:
    """The inverse of remapped by the same ids."""
    return remapped(g, ids.select(F.col("number").alias("id"), F.col("id").alias("number")))


# samples


def nodes_in_random_order(g: Graph, seed: int = 1) -> DataFrame:
    """(id), ordered by a hash: the same order for the same seed."""
    return g.vertices.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id")


def random_nodes(g: Graph, k: int, seed: int = 1) -> DataFrame:
    """k different nodes (all, if fewer), each set as likely as another."""
    return nodes_in_random_order(g, seed).limit(k)


def random_edges(g: Graph, k: int, seed: int = 1) -> DataFrame:
    """k different edges, uniformly."""
    return g.edges.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(k)


def random_neighbours(g: Graph, seed: int = 1) -> DataFrame:
    """(u, v): one neighbour of each node that has any."""
    pick = F.min(F.struct(F.xxhash64("u", "v", F.lit(seed)).alias("h"), "v"))
    return g.arcs().groupBy("u").agg(pick.alias("p")).select("u", F.col("p.v").alias("v"))


# traversals


def bfs_edges(g: Graph, sources: DataFrame) -> DataFrame:
    """(parent, node, distance): each reached node but the sources with the least neighbour one hop nearer."""
    d = bfs(g, sources).select("node", "distance")
    a = g.arcs().select("u", "v").join(d.select(F.col("node").alias("u"), F.col("distance").alias("x")), "u").join(d.select(F.col("node").alias("v"), F.col("distance").alias("y")), "v")
    return a.where("y = x + 1").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"), F.min("y").alias("distance")).select("parent", "node", "distance")


def topological_order(g: Graph) -> DataFrame:
    """(node, layer, position) of a directed graph without cycles: layer by layer, by id within a layer. Cycles are an error."""
    if not g.directed:
        raise ValueError("an undirected graph has no topological order")
    arcs, left, done, layer = materialize(g.edges.select("src", "dst"), "topo-e"), materialize(g.vertices.select("id"), "topo-v"), None, 0
    while not left.isEmpty():
        ready = materialize(left.join(arcs.select(F.col("dst").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.lit(layer).alias("layer")), "topo")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        done = ready if done is None else done.union(ready)
        gone = ready.select(F.col("node").alias("id"))
        new_left, new_arcs = materialize(left.join(gone, "id", "left_anti"), "topo-v"), materialize(arcs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti"), "topo-e")
        discard(left, arcs)
        left, arcs, layer = new_left, new_arcs, layer + 1
    if done is None:
        return g.vertices.select(F.col("id").alias("node"), F.lit(0).alias("layer"), F.lit(0).cast("long").alias("position"))
    return numbered(done, "layer", "node", name="position")


def is_bipartite(g: Graph) -> DataFrame:
    """One row: bipartite, and if so the sizes of both sides in a colouring by parity of the distance from each component's least node."""
    from graphloom.operators.iterative import connected_components

    roots = connected_components(g).select(F.col("component").alias("id")).distinct()
    both = Graph(g.vertices, g.edges, False)
    side = materialize(bfs(both, roots).select("node", (F.col("distance") % 2).alias("side")), "side")
    s = lambda c, n: side.select(F.col("node").alias(c), F.col("side").alias(n))
    odd = g.edges.join(s("src", "a"), "src").join(s("dst", "b"), "dst").where("a = b").agg(F.count("*").alias("bad"))
    n = side.agg(F.count_if(F.expr("side = 0")).alias("left_nodes"), F.count_if(F.expr("side = 1")).alias("right_nodes"))
    one = F.lit(1).alias("_k")
    good = F.col("bad") == 0
    return odd.select("bad", one).join(n.select("*", one), "_k").select(good.alias("bipartite"), F.when(good, F.col("left_nodes")).alias("left_nodes"), F.when(good, F.col("right_nodes")).alias("right_nodes"))


# attributes


def with_node_attribute(g: Graph, name: str, values: DataFrame) -> Graph:
    """g whose vertices have one more column, from values (node, value); null where none is given. Names are taken once."""
    if name in g.vertices.columns:
        raise ValueError(f"nodes have an attribute {name}")
    v = g.vertices.join(values.select(F.col("node").alias("id"), F.col("value").alias(name)), "id", "left")
    return Graph(v, g.edges, g.directed)


def with_edge_attribute(g: Graph, name: str, values: DataFrame) -> Graph:
    """g whose edges have one more column, from values (src, dst, value)."""
    if name in g.edges.columns:
        raise ValueError(f"edges have an attribute {name}")
    new = _oriented(g, values.select("src", "dst", F.col("value").alias(name)))
    return Graph(g.vertices, g.edges.join(new, ["src", "dst"], "left"), g.directed)


def without_attribute(g: Graph, name: str) -> Graph:
    if name in ("id", "src", "dst", "weight"):
        raise ValueError(f"{name} is no attribute")
    return Graph(g.vertices.drop(name), g.edges.drop(name), g.directed)


def attributes(g: Graph) -> list[tuple[str, str, str]]:
    """(of, name, type): what nodes and edges have beside ids and weights."""
    return [("node", n, t) for n, t in g.vertices.dtypes if n != "id"] + [("edge", n, t) for n, t in g.edges.dtypes if n not in ("src", "dst", "weight")]


def node_attribute(g: Graph, name: str) -> DataFrame:
    """(node, value) of the nodes that have one."""
    return g.vertices.select(F.col("id").alias("node"), F.col(name).alias("value")).where("value IS NOT NULL")


def write_node_attribute(g: Graph, name: str, path: str) -> None:
    """Lines `node<TAB>value`."""
    node_attribute(g, name).select(F.concat_ws("\t", F.col("node").cast("string"), F.col("value").cast("string"))).write.text(path)


def read_node_attribute(g: Graph, name: str, path: str, kind: str = "double") -> Graph:
    p = F.split(F.col("value"), "\t", 2)
    return with_node_attribute(g, name, g.vertices.sparkSession.read.text(path).select(p[0].cast("long").alias("node"), p[1].cast(kind).alias("value")))


def overview(g: Graph) -> DataFrame:
    """One row: size, density, extremes of the degree, isolated nodes and self-loops."""
    from graphloom.operators.structure import size

    d = degrees(g).agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"), F.count_if(F.expr("degree = 0")).alias("isolated"))
    one = F.lit(1).alias("_k")
    return size(g).select("*", one).join(d.select("*", one), "_k").drop("_k")


#: Different values whose ranks are added up in one task, and that may be broadcast.
RANKS = 100_000


def ranked(values: DataFrame, value_col: str = "value") -> DataFrame:
    """values with the mean rank (from 1) of each value in ascending order, ties sharing it."""
    k = materialize(numbered(values.groupBy(value_col).agg(F.count("*").alias("_k")), value_col, name="_n"), "ranks")  # equal values are one row
    few = F.expr(f"_n div {RANKS}")
    sums = k.groupBy(few.alias("_b")).agg(F.sum("_k").alias("_s"))
    base = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("_k").over(Window.partitionBy("_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = k.withColumn("_b", few).withColumn("_w", within).join(F.broadcast(base), "_b").select(value_col, (F.col("_base") + F.col("_w") + (F.col("_k") + 1) / 2).alias("rank"))
    return values.join(F.broadcast(n) if k.count() <= RANKS else n, value_col)


def gini(values: DataFrame, value_col: str = "value") -> DataFrame:
    """One row: the Gini coefficient, 2 sum(rank * x) / (n sum x) - (n + 1) / n, of values that are not negative."""
    r = ranked(values, value_col)
    s = r.agg(F.count("*").alias("n"), F.sum(value_col).alias("s"), F.sum(F.col("rank") * F.col(value_col)).alias("rs"))
    return s.select(F.when(F.col("s") > 0, 2 * F.col("rs") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))
