"""Breadth-first searches from many sources at once: sets of sources are masks of 63 bits that move along the arcs.

A table (node, word, seen, front) holds, for each node and each 63 sources, who has reached it and who did so at
the last hop. A hop is one join of the arcs with the fronts, one bit_or per node and word, and one join with what
was seen; neither the graph nor a frontier leaves Spark's tables. Work grows with arcs times sources / 63, so that
large graphs take a sample of sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.numbering import numbered
from graphloom.plans.scratch import discard, materialize

#: Sources of a mask; the sign is left alone.
WORD = 63
#: Sources that top_closeness searches from at a time; their counts of a hop come to the driver.
BATCH = 1024
#: Hops whose fronts are counted at once.
LOT = 16


def _bit(mask: Column, i: int) -> Column:
    return F.shiftrightunsigned(mask, i).bitwiseAND(F.lit(1).cast("long"))


def _masks(bits: Column) -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def placed(sources: DataFrame) -> DataFrame:
    """(source, word, bit): sources(id) dealt to masks by rising id."""
    return materialize(numbered(sources.select(F.col("id").alias("source")).distinct(), "source").select("source", F.expr(f"number div {WORD}").alias("word"), (F.col("number") % WORD).cast("int").alias("bit")), "sources")


def hops(arcs: DataFrame, places: DataFrame, most: int | None = None, keep: bool = False) -> Iterator[DataFrame]:
    """States (node, word, seen, front) after 0, 1, 2, ... hops, the last of them without fronts, or after `most`; unless they are kept, a state is gone when the one after the next is made.

    The places that are still wanted may be sent in: sources left out stop searching.
    """
    start = places.groupBy(F.col("source").alias("node"), "word").agg(_masks(F.col("bit")).alias("seen"))
    state, before, hop = materialize(start.withColumn("front", F.col("seen")), "hop"), None, 0
    while True:
        wanted = yield state
        if not keep:
            discard(before)
        front = state.where("front <> 0").select(F.col("node").alias("u"), "word", "front")
        if hop == most or front.isEmpty():
            if not keep:
                discard(state)
            return
        if wanted is not None:
            live = wanted.groupBy("word").agg(_masks(F.col("bit")).alias("live"))
            front = front.join(live, "word").select("u", "word", F.col("front").bitwiseAND(F.col("live")).alias("front")).where("front <> 0")
        told = arcs.join(front, "u").groupBy(F.col("v").alias("node"), "word").agg(F.bit_or("front").alias("told"))
        seen = F.coalesce("seen", F.lit(0).cast("long"))
        fresh = F.coalesce("told", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(seen))
        before, hop = state, hop + 1
        state = materialize(state.drop("front").join(told, ["node", "word"], "full").select("node", "word", seen.bitwiseOR(fresh).alias("seen"), fresh.alias("front")), "hop")


def _arcs(g: Graph) -> DataFrame:
    return materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "arcs")


def _by_source(rows: DataFrame, places: DataFrame, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(source, x), and by: for each source, how many rows (word, front) hold its bit, or the sum of their weights. One row of sums per word."""
    one = [F.sum(_bit(F.col("front"), i) * (F.lit(1) if weight is None else weight)).alias(f"b{i}") for i in range(WORD)]
    sums = rows.where("front <> 0").groupBy("word", *by).agg(*one).select("word", *by, F.posexplode(F.array(*[f"b{i}" for i in range(WORD)])).alias("bit", "x"))
    return places.join(sums, ["word", "bit"]).where("x <> 0").select("source", "x", *by)


def _chosen(g: Graph, sources: DataFrame | None) -> DataFrame:
    return g.vertices if sources is None else sources.join(g.vertices, "id", "left_semi")


def _fronts(arcs: DataFrame, places: DataFrame, most: int | None, look: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """look at the rows (node, word, front, hop) of all hops, which come in lots of LOT hops; its results are written, the states removed."""
    parts, lot = [], []

    def close() -> None:
        rows = [x.where("front <> 0").select("node", "word", "front", F.lit(h).alias("hop")) for h, x in lot]
        parts.append(materialize(look(reduce(DataFrame.union, rows)), "hops"))
        discard(*[x for _, x in lot[:-1]])  # the last is still read by the next hop
        lot.clear()

    for hop, state in enumerate(hops(arcs, places, most, keep=True)):
        if len(lot) == LOT:
            close()
        lot.append((hop, state))
    close()
    return reduce(DataFrame.union, parts)


def reach_counts(g: Graph, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(source, hop, nodes): how many nodes each of sources(id), or each node, first reaches at each hop; itself at hop 0."""
    arcs, places = _arcs(g), placed(_chosen(g, sources))
    return _fronts(arcs, places, most, lambda rows: _by_source(rows, places, by=("hop",)).select("source", "hop", F.col("x").alias("nodes")))


def _without_leaves(g: Graph) -> tuple[Graph, DataFrame]:
    """An undirected graph without its leaves, and (leaf, node) of them all. Of an edge between two leaves, the larger is one."""
    arcs = _arcs(g)
    ends = arcs.groupBy("u").agg(F.count("*").alias("k"), F.min("v").alias("v")).where("k = 1").select("u", "v")
    pairs = ends.join(ends.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"]).where("u < v")
    leaves = materialize(ends.join(pairs, ["u", "v"], "left_anti").select(F.col("u").alias("leaf"), F.col("v").alias("node")), "leaves")
    gone = lambda c: leaves.select(F.col("leaf").alias(c))
    rest = arcs.where("u > v").join(gone("u"), "u", "left_anti").join(gone("v"), "v", "left_anti")
    edges = materialize(rest.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("weight")), "rest")
    return Graph(g.vertices.select("id").join(gone("id"), "id", "left_anti"), edges), leaves


def ball_total(g: Graph, radius: int) -> DataFrame:
    """One row, nodes: within radius of a node of an undirected graph, summed over all nodes; radius 2 at least.

    Leaves are not searched from: what lies within radius of one lies within radius - 1 of its neighbour. Nor are
    they searched for: a node's leaves lie one hop beyond it.
    """
    rest, leaves = _without_leaves(g)
    held = materialize(leaves.groupBy("node").agg(F.count("*").alias("k")), "held")

    def look(rows: DataFrame) -> DataFrame:
        own = rows.select("node", "word", "front", "hop", F.lit(1).cast("long").alias("k"))
        both = own.union(rows.join(held, "node").select("node", "word", "front", F.col("hop") + 1, "k"))
        return _by_source(both, places, F.col("k"), ("hop",)).select("source", "hop", "x")

    places = placed(rest.vertices)
    found = _fronts(_arcs(rest), places, radius, look).where(F.col("hop") <= radius)
    sums = found.groupBy("source").agg(F.sum("x").alias("own"), F.sum(F.when(F.col("hop") < radius, F.col("x"))).alias("leaf"))
    return sums.join(held.withColumnRenamed("node", "source"), "source", "left").agg(F.sum(F.col("own") + F.col("leaf") * F.coalesce("k", F.lit(0))).alias("nodes"))


def first_within(g: Graph, need: int) -> DataFrame:
    """(source, hops): the least hops within which need nodes lie, the node itself included; nodes that reach fewer are left out.

    Nodes whose component is too small are not searched from, nor are those whose neighbours suffice; a search ends once it has reached enough.
    """
    from graphloom.operators.iterative import connected_components

    if need <= 1:
        return g.vertices.select(F.col("id").alias("source"), F.lit(0).alias("hops"))
    g = g.materialized()
    comp = materialize(connected_components(g), "comp")
    large = comp.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= need)
    inside = materialize(comp.join(large, "component", "left_semi").select(F.col("node").alias("u")), "inside")
    arcs = materialize(_arcs(g).join(inside, "u", "left_semi"), "arcs")
    near = materialize(inside.join(arcs.groupBy("u").agg(F.count("*").alias("k")), "u", "left").select(F.col("u").alias("id"), (F.col("k") + 1 >= need).alias("enough")), "near")
    done = near.where("enough").select(F.col("id").alias("source"), F.lit(1).alias("hops"))
    left = near.where("NOT coalesce(enough, false)").select("id")
    if left.isEmpty():
        return done
    places = placed(left)
    rows = materialize(places.select("source", F.lit(0).cast("long").alias("reached"), F.lit(None).cast("int").alias("hops")), "within")
    search = hops(arcs, places)
    state, hop = next(search), 0
    while True:
        reached = F.col("reached") + F.coalesce("x", F.lit(0))
        new = rows.join(_by_source(state, places), "source", "left").select("source", reached.alias("reached"), F.coalesce("hops", F.when(reached >= need, F.lit(hop))).alias("hops"))
        rows, old = materialize(new, "within"), rows
        discard(old)
        live = rows.where("hops IS NULL").select("source")
        if live.isEmpty():
            discard(state)
            break
        try:
            state, hop = search.send(places.join(live, "source", "left_semi")), hop + 1
        except StopIteration:
            break
    return done.union(rows.where("hops IS NOT NULL").select("source", "hops"))


def pivot_sums(g: Graph, pivots: DataFrame) -> DataFrame:
    """(node, pivots, total, nearest, hops): how many pivots(id) reach a node, the sum of their distances, and the nearest, of several the least, with its distance."""
    arcs, places = _arcs(g), placed(_chosen(g, pivots))
    lowest = F.bit_count(F.col("front").bitwiseAND(-F.col("front")) - 1)
    rows = _fronts(arcs, places, None, lambda x: x.groupBy("node", "hop").agg(F.sum(F.bit_count("front")).alias("k"), F.min(F.col("word") * WORD + lowest).alias("first")))
    at = F.min(F.struct("hop", "first"))
    sums = rows.groupBy("node").agg(F.sum("k").alias("pivots"), F.sum(F.col("k") * F.col("hop")).alias("total"), at.alias("m"))
    name = places.select(F.col("source").alias("nearest"), (F.col("word") * WORD + F.col("bit")).alias("first"))
    return sums.withColumns({"first": F.col("m.first"), "hops": F.col("m.hop")}).join(name, "first").select("node", "pivots", "total", "nearest", "hops")


def top_closeness(g: Graph, k: int = 1, harmonic: bool = False, batch: int = BATCH) -> DataFrame:
    """(node, score): exactly the k nodes of greatest closeness (reached - 1)^2 / (sum (n - 1)), or of harmonic closeness over n - 1; ties to smaller ids.

    Nodes are searched from in batches, those first whose degree, neighbours' degrees and component promise most. A search ends when
    what it has reached, with all else of its component at the next hop but one, can't come near the k best; the
    rest is not searched from at all once no promise exceeds the least of the k best.
    """
    from graphloom.operators.iterative import connected_components

    n = g.vertices.count()
    spark = g.vertices.sparkSession
    arcs = _arcs(g)
    comp = materialize(connected_components(g), "comp")
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    large = F.broadcast(sizes.where(F.col("size") * 1000 > n))  # fewer than 1000
    size = comp.join(large, "component").union(comp.join(large, "component", "left_anti").join(sizes, "component"))
    deg = arcs.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    one = max(n - 1, 1)

    def promise(reached: Column, total: Column, hop: Column, comp: Column) -> Column:
        """An upper bound of the score when so many nodes are reached up to hop, and all others lie beyond it."""
        left = comp - reached
        if harmonic:
            return (total + left / (hop + 1)) / one
        far = total + left * (hop + 1)
        bound = F.when(far > 0, (comp - 1) * (comp - 1) / far / one).otherwise(0.0)
        if not g.directed:
            return bound
        # of directed graphs all or none of the rest may be reached; what lies between promises less than one of the two
        return F.greatest(bound, F.when(total > 0, (reached - 1) * (reached - 1) / total / one).otherwise(0.0))

    degree = F.coalesce("degree", F.lit(0))
    total = degree.cast("double")
    most = promise(degree + 1, total, F.lit(1), F.col("size"))
    nodes = size.join(deg, "node", "left")
    if harmonic or not g.directed:  # no more are two hops away than the neighbours have neighbours of their own
        deg = materialize(deg, "degrees")
        around = arcs.join(deg.withColumnsRenamed({"node": "v", "degree": "around"}), "v").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("around") - (0 if g.directed else 1)).alias("around"))
        nodes = nodes.join(around, "node", "left")
        two = F.least(F.coalesce("around", F.lit(0)), F.col("size") - degree - 1)
        most = F.least(most, promise(degree + 1 + two, total + (two / 2 if harmonic else two * 2), F.lit(2), F.col("size")))
    nodes = nodes.select("node", "size", most.alias("most"))
    order = materialize(numbered(nodes, F.col("most").desc(), "node"), "order")
    best: list[tuple[float, int]] = []
    at, some = 0, min(batch, max(k, WORD))  # few at first: what they score spares searches of the others
    while at < n:
        lot = order.where((F.col("number") >= at) & (F.col("number") < at + some))
        floor = best[-1][0] if best and len(best) == k else -1.0
        if k <= 0 or (lot.agg(F.max("most")).first()[0] or 0.0) < floor - 1e-12:
            break
        lot = materialize(lot.where(F.col("most") >= floor - 1e-12), "lot")
        places = placed(lot.select(F.col("node").alias("id")))
        rows = materialize(lot.select(F.col("node").alias("source"), "size", F.lit(0).cast("long").alias("reached"), F.lit(0.0).alias("total")), "lot")
        search = hops(arcs, places)
        state, hop = next(search), 0
        while True:
            got = _by_source(state, places)
            gain = F.coalesce("x", F.lit(0))
            worth = (gain / hop if harmonic else gain * hop) if hop else F.lit(0.0)
            rows, old = materialize(rows.join(got, "source", "left").select("source", "size", (F.col("reached") + gain).alias("reached"), (F.col("total") + worth).alias("total")), "lot"), rows
            discard(old)
            live = rows.where(promise(F.col("reached"), F.col("total"), F.lit(hop), F.col("size")) >= floor - 1e-12)
            rows = _kept(live, rows)
            try:
                state, hop = search.send(places.join(live.select("source"), "source", "left_semi")), hop + 1
            except StopIteration:
                break
        score = F.col("total") / one if harmonic else F.when(F.col("total") > 0, (F.col("reached") - 1) * (F.col("reached") - 1) / F.col("total") / one).otherwise(0.0)
        found = [(r["score"], r["source"]) for r in rows.select("source", score.alias("score")).orderBy(F.desc("score"), "source").limit(k).collect()]
        best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
        at, some = at + some, min(batch, 4 * some)
    discard(arcs, order)
    return spark.createDataFrame([(i, float(s)) for s, i in best], "node long, score double")


def _kept(view: DataFrame, written: DataFrame) -> DataFrame:
    """view, to be discarded with the table it reads."""
    view._scratch_path = written._scratch_path
    return view


def _greedy(g: Graph, k: int, gain: Callable[[Column, Column], Column], start: Column) -> list[int]:
    """Nodes that one by one add most: gain(d, h) is what a node at distance d from the group adds when it comes within h hops of a new member."""
    arcs, places = _arcs(g), placed(g.vertices)
    near = materialize(g.vertices.select(F.col("id").alias("node"), start.alias("d")), "near")
    group: list[int] = []
    for _ in range(k):
        near_ = near.select("node", "d")
        parts = _fronts(arcs, places, None, lambda x, near_=near_: _by_source(x.join(near_, "node").select("word", "front", "hop", gain(F.col("d"), F.col("hop")).alias("w")), places, F.col("w")))
        sums = parts.groupBy("source").agg(F.sum("x").alias("x"))
        left = places.select("source").where(~F.col("source").isin(group)) if group else places.select("source")
        top = left.join(sums, "source", "left").orderBy(F.coalesce("x", F.lit(0.0)).desc(), "source").first()
        if top is None:
            break
        group.append(top["source"])
        mine = placed(g.vertices.where(F.col("id") == top["source"]))
        found = _fronts(arcs, mine, None, lambda x: x.select("node", F.col("hop").cast("double").alias("h")))
        near = materialize(near.join(found, "node", "left").select("node", F.least("d", F.coalesce("h", "d")).alias("d")), "near")
    discard(arcs)
    return group


def group_closeness(g: Graph, k: int = 1, harmonic: bool = False) -> DataFrame:
    """(position, node): greedily the group with the least sum of distances, unreached nodes at n, or the largest sum of 1 / distance, members at 0; ties to smaller ids."""
    n = float(g.vertices.count())
    if harmonic:  # a member's own share is lost, one over a distance that falls is won; d of n + 1 is unreached
        share = lambda d: F.when((d > 0) & (d <= n), 1 / d).otherwise(0.0)
        gain, start = (lambda d, h: F.when(h == 0, -share(d)).when(d > 0, F.greatest(1 / h - share(d), F.lit(0.0))).otherwise(0.0)), F.lit(n + 1)
    else:
        gain, start = (lambda d, h: F.greatest(d - h, F.lit(0.0))), F.lit(n)
    group = _greedy(g, k, gain, start)
    return g.vertices.sparkSession.createDataFrame(list(enumerate(group)), "position int, node long")
