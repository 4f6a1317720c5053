"""Biconnected components in tables: a spanning forest, its Euler tour ranked by doubled pointers, reach of subtrees, and components of tree edges.

Two tree edges, each named by its lower node, are in one component if an edge off the forest joins nodes of which
neither is above the other, or if one is right below the other and an edge leaves its subtree past the upper node.
Preorder numbers make subtrees ranges, and what leaves a range is a least and a greatest number over it, put together
from blocks of powers of two. All steps are joins and aggregations; the number of rounds grows with the logarithm of
the node count, whatever the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.components import star_components
from graphloom.plans.numbering import numbered
from graphloom.plans.scratch import discard, materialize

#: Blocks of the upper levels, at most 2 ** (TOP + 1) rows, are sent to all tasks: many ranges may ask for one of them.
#: A lower block is asked for only by ranges that end in its neighbour.
TOP = 12


def rooted_forest(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of a spanning forest, and (node, root) of all nodes with edges: rounds in which each tree takes its least edge outwards, and pointers to roots are doubled."""
    e = materialize(g.edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().withColumns({"a": F.col("src"), "b": F.col("dst")}), "forest-e")
    label = materialize(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("root", F.col("node")), "forest-l")
    tree = materialize(e.select("src", "dst").where("false"), "forest")
    while not e.isEmpty():
        sides = e.select("src", "dst", F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to")), F.struct(F.col("b").alias("c"), F.col("a").alias("to")))).alias("s"))
        pick = materialize(sides.groupBy("s.c").agg(F.min(F.struct("src", "dst", "s.to")).alias("m")).select("c", "m.*"), "forest-p")
        tree, old = materialize(tree.union(pick.select("src", "dst").distinct()), "forest"), tree
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = materialize(pick.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")), "forest-up")
        discard(old)
        moved = True
        while moved:
            nxt = materialize(up.join(up.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "forest-up")
            moved = not nxt.where("moved").isEmpty()
            discard(up)
            up = nxt.select("c", "p")
            up._scratch_path = nxt._scratch_path
        at = lambda c, n: up.select(F.col("c").alias(c), F.col("p").alias(n))
        fresh = materialize(label.join(at("root", "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "forest-l")
        left = materialize(e.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y").select("src", "dst", F.col("x").alias("a"), F.col("y").alias("b")), "forest-e")
        discard(e, label, pick, up)
        e, label = left, fresh
    discard(e)
    return tree, label


def preorder(tree: DataFrame, label: DataFrame) -> DataFrame:
    """(node, parent, pre, size): places in one walk through the trees of (src, dst) from the roots of (node, root), and sizes of subtrees; roots have no parent."""
    arcs = tree.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(tree.select("dst", "src"))
    arcs = materialize(numbered(arcs, "u", "v", name="i").select("u", "v", "i"), "tour")
    spans = arcs.groupBy("u").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    spans = spans.join(label.select(F.col("node").alias("u"), F.col("root")), "u").select(F.col("u").alias("v"), "first", "last", (F.col("u") == F.col("root")).alias("top"))
    twins = arcs.join(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("i").alias("j")), ["u", "v"])
    # after u -> v the walk leaves v by the arc after v -> u, round and round, and ends where it would leave a root for the second time
    after = F.when(F.col("j") < F.col("last"), F.col("j") + 1).when(~F.col("top"), F.col("first"))
    rank = materialize(twins.join(spans, "v").select("u", "v", "i", "j", after.alias("next")).withColumn("d", F.col("next").isNotNull().cast("long")), "rank")
    while not rank.where("next IS NOT NULL").isEmpty():
        ahead = rank.select(F.col("i").alias("next"), F.col("next").alias("beyond"), F.col("d").alias("more"))
        nxt = materialize(rank.join(ahead, "next", "left").select("u", "v", "i", "j", F.col("beyond").alias("next"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")), "rank")
        discard(rank)
        rank = nxt
    down = rank.select("u", "v", "i", "j", "d").join(rank.select(F.col("i").alias("j"), F.col("d").alias("up")), "j").where("d > up")
    below = down.select(F.col("v").alias("node"), F.col("u").alias("parent"), "d", F.expr("(d - up + 1) div 2").alias("size"))
    sizes = label.groupBy("root").agg(F.count("*").alias("size"))
    tops = sizes.select(F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), (2 * F.col("size")).alias("d"), "size")
    nodes = below.union(tops).join(label, "node")
    out = materialize(numbered(nodes, "root", F.col("d").desc(), name="pre").select("node", "parent", "pre", "size"), "preorder")
    discard(arcs, rank)
    return out


def range_bounds(values: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """(node, lo, hi): the least lo and the greatest hi of values(at, lo, hi) over at in [start, start + size) of ranges(node, start, size); numbers below n, no range empty."""
    levels = max(n - 1, 1).bit_length()
    low = max(levels - TOP, 0)
    at = values.select("lo", "hi", "at", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    blocks = materialize(at.groupBy("level", F.expr("shiftright(at, level)").alias("block")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "blocks")
    first, end = "shiftright(start + shiftleft(1L, k) - 1, k)", "shiftright(start + size, k)"
    pieces = f"""inline(filter(flatten(transform(sequence(0, {levels}), k -> array(
        named_struct('level', k, 'block', if({first} < {end} AND {first} % 2 = 1, {first}, NULL)),
        named_struct('level', k, 'block', if({first} < {end} AND {end} % 2 = 1, {end} - 1, NULL))))), x -> x.block IS NOT NULL))"""
    asks = ranges.select("node", F.expr(pieces))
    near = asks.where(F.col("level") < low).join(blocks.where(F.col("level") < low), ["level", "block"])
    far = asks.where(F.col("level") >= low).join(F.broadcast(blocks.where(F.col("level") >= low)), ["level", "block"])
    return near.select("node", "lo", "hi").union(far.select("node", "lo", "hi")).groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def block_edges(g: Graph) -> DataFrame:
    """(src, dst, component) of each different edge of an undirected graph; loops are in none, parallel edges count as one.

    A component is named by the least of its nodes, its node nearest the root of the spanning tree left out, which
    no other component has as its name.
    """
    if g.directed:
        raise ValueError("biconnected components are those of undirected graphs")
    tree, label = rooted_forest(g)
    if tree.isEmpty():
        return tree.withColumn("component", F.col("src"))
    nodes = preorder(tree, label)
    n = nodes.count()
    spot = lambda c, x: nodes.select(F.col("node").alias(c), F.col("pre").alias("p" + x), F.col("size").alias("s" + x))
    edges = g.edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    rest = edges.join(tree, ["src", "dst"], "left_anti").join(spot("src", "a"), "src").join(spot("dst", "b"), "dst")
    first = F.col("pa") < F.col("pb")
    pick = lambda one, two: F.when(first, F.col(one)).otherwise(F.col(two))
    # u comes before v in the walk, so v lies below u or beside it
    rest = materialize(rest.select("src", "dst", pick("src", "dst").alias("u"), pick("dst", "src").alias("v"), pick("pa", "pb").alias("pu"), pick("pb", "pa").alias("pv"), pick("sa", "sb").alias("su")), "rest")
    reach = rest.select(F.col("u").alias("node"), F.col("pv").alias("p")).union(rest.select("v", "pu")).groupBy("node").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    own = nodes.join(reach, "node", "left").select(F.col("pre").alias("at"), F.least("pre", F.coalesce("lo", "pre")).alias("lo"), F.greatest("pre", F.coalesce("hi", "pre")).alias("hi"))
    bounds = range_bounds(own, nodes.where("parent IS NOT NULL").select("node", F.col("pre").alias("start"), "size"), n)
    above = nodes.where("parent IS NOT NULL").select(F.col("node").alias("parent"), "pre", "size")
    leaves = nodes.select("node", "parent").join(above, "parent").join(bounds, "node").where("lo < pre OR hi >= pre + size").select("node", F.col("parent").alias("other"))
    beside = rest.where("pv >= pu + su").select(F.col("u").alias("node"), F.col("v").alias("other"))
    parts = star_components(leaves.union(beside), "node", "other")
    named = materialize(nodes.where("parent IS NOT NULL").select("node", "parent").join(parts, "node", "left").select("node", "parent", F.coalesce("component", "node").alias("component")), "named")
    of_tree = named.select(F.greatest("node", "parent").alias("src"), F.least("node", "parent").alias("dst"), "component")
    of_rest = rest.join(named.select(F.col("node").alias("v"), "component"), "v").select("src", "dst", "component")
    return of_tree.union(of_rest)


def biconnected_components(g: Graph) -> DataFrame:
    """(node, component), cut nodes in several; names as in block_edges. Nodes without edges to others are in none."""
    e = block_edges(g)
    return e.select(F.explode(F.array("src", "dst")).alias("node"), "component").distinct()
