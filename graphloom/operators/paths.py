"""Paths, searches and distance measures beyond plain breadth-first search and shortest paths.

Single-source measures are relational rounds, and so are counts of hops from many nodes (multisource). What else
starts from many nodes runs per source over a broadcast graph of checked size (kernels.csr.MAX_EDGES).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels.csr import Csr, TooLarge, collect, frame, per_source
from graphloom.operators.iterative import bfs, connected_components, shortest_paths
from graphloom.operators.multisource import ball_total, first_within, reach_counts
from graphloom.operators.structure import transpose
from graphloom.plans.scratch import discard, materialize


def _one(g: Graph, node: int) -> DataFrame:
    return g.vertices.where(F.col("id") == node).select("id")


def depth_first(g: Graph, source: int) -> DataFrame:
    """(position, node, parent) in depth-first order; sequential, so on the driver."""
    from graphloom.kernels.order import dfs

    c = collect(g)
    rows = [(i, c.ids[u], c.ids[p] if p >= 0 else None) for i, (u, p) in enumerate(dfs(c, c.index([source])[0]))]
    return frame(g, rows, "position long, node long, parent long")


def predecessors(g: Graph, distances: DataFrame) -> DataFrame:
    """(node, predecessor): every neighbour by which distances (node, distance) are reached, by weight."""
    d = lambda c, x: distances.select(F.col("node").alias(c), F.col("distance").cast("double").alias(x))
    a = g.arcs().join(d("u", "x"), "u").join(d("v", "y"), "v")
    return a.where(F.abs(F.col("x") + F.col("w") - F.col("y")) <= 1e-9 * (1 + F.abs("y"))).where("u <> v").select(F.col("v").alias("node"), F.col("u").alias("predecessor")).distinct()


def shortest_path(g: Graph, source: int, target: int) -> DataFrame:
    """(position, node) of one shortest path by weight, of equal predecessors the least; no rows where there is none."""
    pred = materialize(predecessors(g, shortest_paths(g, _one(g, source))).groupBy("node").agg(F.min("predecessor").alias("p")), "pred")
    walk, at = [target], target
    while at != source:
        row = pred.where(F.col("node") == at).first()
        if row is None:
            return g.vertices.sparkSession.createDataFrame([], "position int, node long")
        at = row["p"]
        walk.append(at)
    return g.vertices.sparkSession.createDataFrame(list(enumerate(walk[::-1])), "position int, node long")


def shortest_path_counts(g: Graph, source: int) -> DataFrame:
    """(node, distance, paths): shortest paths by weight (above 0), counted in rounds over the predecessors."""
    d = materialize(shortest_paths(g, _one(g, source)), "dist")
    dag = materialize(predecessors(g, d), "dag")
    waiting = dag.groupBy("node").agg(F.count("*").alias("need"))
    done = materialize(d.join(waiting, "node", "left_anti").select("node", F.lit(1.0).alias("paths")), "paths")
    while True:
        got = dag.join(done.withColumnRenamed("node", "predecessor"), "predecessor").groupBy("node").agg(F.sum("paths").alias("paths"), F.count("*").alias("have"))
        ready = materialize(got.join(waiting, "node").where("have = need").join(done, "node", "left_anti").select("node", got["paths"]), "paths")
        if ready.isEmpty():
            break
        done = materialize(done.union(ready), "paths")
    return d.join(done, "node").select("node", "distance", "paths")


def all_simple_paths(g: Graph, source: int, target: int, cutoff: int | None = None) -> DataFrame:
    """(path): every path without repeated nodes, of at most cutoff edges; partial paths grow by one join a round."""
    arcs = materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "arcs")
    # a node that can't reach the target within what is left is no way
    back = bfs(transpose(g) if g.directed else g, _one(g, target)).select(F.col("node").alias("v"), "distance")
    arcs = materialize(arcs.join(back, "v"), "arcs")
    walks = _one(g, source).select(F.array("id").alias("path"), F.col("id").alias("u"))
    found, hop = [], 0
    while cutoff is None or hop < cutoff:
        hop += 1
        left = F.lit(True) if cutoff is None else F.col("distance") <= cutoff - hop
        walks = materialize(walks.join(arcs, "u").where(left & ~F.array_contains("path", F.col("v"))).select(F.array_append("path", F.col("v")).alias("path"), F.col("v").alias("u")), "walks")
        if walks.isEmpty():
            break
        found.append(walks.where(F.col("u") == target).select("path"))
        walks = walks.where(F.col("u") != target)
    out = g.vertices.sparkSession.createDataFrame([], "path array<long>")
    for f in found:
        out = out.union(f)
    return out


def reverse_bfs(g: Graph, sources: DataFrame) -> DataFrame:
    """bfs along arcs against their direction."""
    return bfs(transpose(g) if g.directed else g, sources)


def bidirectional_bfs(g: Graph, source: int, target: int) -> DataFrame:
    """One row: hops from source to target, found by two fronts that grow in turn, the smaller first; null where none."""
    spark, arcs = g.vertices.sparkSession, materialize(g.arcs().select("u", "v").distinct(), "arcs")
    seen = {s: materialize(_one(g, x).select(F.col("id").alias("node")), "seen") for s, x in (("out", source), ("in", target))}
    front, hops, size = dict(seen), {"out": 0, "in": 0}, {"out": 1, "in": 1}
    if source == target:
        return spark.createDataFrame([(0,)], "distance int")
    while True:
        side = "out" if size["out"] <= size["in"] else "in"
        a, b = ("u", "v") if side == "out" else ("v", "u")
        new = arcs.join(front[side].withColumnRenamed("node", a), a).select(F.col(b).alias("node")).distinct().join(seen[side], "node", "left_anti")
        front[side] = materialize(new, "front")
        hops[side] += 1
        size[side] = front[side].count()
        if not size[side]:
            return spark.createDataFrame([(None,)], "distance int")
        if not front[side].join(seen["in" if side == "out" else "out"], "node", "left_semi").isEmpty():
            return spark.createDataFrame([(hops["out"] + hops["in"],)], "distance int")
        seen[side] = materialize(seen[side].union(front[side]), "seen")


def target_distances(g: Graph, source: int, targets: DataFrame, weighted: bool = False) -> DataFrame:
    """(target, distance) of targets(id) from one source, null where unreachable."""
    d = shortest_paths(g, _one(g, source)) if weighted else bfs(g, _one(g, source))
    return targets.select(F.col("id").alias("target")).join(d.select(F.col("node").alias("target"), "distance"), "target", "left")


def pair_distances(g: Graph, sources: DataFrame, targets: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """(source, target, distance) of reached pairs, per source over the broadcast graph."""

    def run(c: Csr, u: int) -> list[tuple]:
        d = c.dijkstra([u])[0] if weighted else c.bfs([u]).astype(float)
        at = np.flatnonzero(np.isfinite(d) & (d >= 0))
        return [(int(c.ids[u]), int(c.ids[v]), float(d[v])) for v in at]

    out = per_source(g, sources, run, "source long, target long, distance double")
    return out if targets is None else out.join(targets.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select("source", "target", "distance")


def apsp(g: Graph) -> DataFrame:
    """(source, target, distance) by weight of all reached pairs."""
    return pair_distances(g, None, weighted=True)


def a_star(g: Graph, source: int, target: int, heuristic: dict[int, float] | Callable[[int], float]) -> DataFrame:
    """(position, node, distance) of a path by weight, the search ordered by a heuristic (by node) that never exceeds what is left. On the driver."""
    c = collect(g)
    h = np.array([heuristic(int(i)) if callable(heuristic) else heuristic.get(int(i), 0.0) for i in c.ids])
    s, t = c.index([source, target])
    dist, pred = c.dijkstra([s], h, t)
    rows = [(i, c.ids[v], float(dist[v])) for i, v in enumerate(c.path(pred, t))] if np.isfinite(dist[t]) else []
    return frame(g, rows, "position int, node long, distance double")


def nearest_first(g: Graph, sources: list[int], explored: set[int] | None = None):
    """Yields (node, distance) by rising weight from several sources, as far as it is asked; explored nodes are not entered. On the driver."""
    import heapq

    c = collect(g)
    skip = set(c.index(sorted(explored))) if explored else set()
    heap, done = [(0.0, u) for u in c.index(sources)], set()
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        yield int(c.ids[u]), d
        for v, x in zip(c.out(u).tolist(), c.weights(u).tolist(), strict=True):
            if v not in done and v not in skip:
                heapq.heappush(heap, (d + x, v))


def bellman_ford(g: Graph, source: int) -> DataFrame:
    """(node, distance, negative): rounds that relax the arcs of changed nodes; after as many rounds as nodes, what still changes hangs on a negative cycle (distance null)."""
    n, arcs = g.vertices.count(), materialize(g.arcs(), "arcs")
    best = changed = materialize(_one(g, source).select(F.col("id").alias("node"), F.lit(0.0).alias("distance")), "bf")
    for _ in range(n):
        offer = arcs.join(changed.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        new = materialize(offer.join(best, "node", "left").where("distance IS NULL OR offer < distance - 1e-12").select("node", F.col("offer").alias("distance")), "changed")
        if new.isEmpty():
            return best.select("node", "distance", F.lit(False).alias("negative"))
        best = materialize(best.join(new.select("node"), "node", "left_anti").union(new), "bf")
        changed = new
    bad = bfs(g, changed.select(F.col("node").alias("id"))).select("node", F.lit(True).alias("negative"))
    both = best.join(bad, "node", "full")
    return both.select("node", F.when(F.col("negative").isNull(), F.col("distance")).alias("distance"), F.coalesce("negative", F.lit(False)).alias("negative"))


#: Nodes of a dense table of distances at most.
DENSE = 3000


def floyd_warshall(g: Graph) -> DataFrame:
    """(source, target, distance, hops, negative) of reached pairs; weights may be below 0, negative marks sources on negative cycles. On the driver, at most DENSE nodes."""
    if g.vertices.count() > DENSE:
        raise TooLarge(f"a table of all pairs is for {DENSE} nodes at most")
    c = collect(g)
    d, hops = np.full((c.n, c.n), np.inf), np.full((c.n, c.n), np.inf)
    np.fill_diagonal(d, 0.0)
    np.fill_diagonal(hops, 0)
    order = np.lexsort((-c.w,))
    for e in order.tolist():
        u, v = c.row[e], c.nbr[e]
        if c.w[e] < d[u, v] or (u != v and c.w[e] == d[u, v]):
            d[u, v], hops[u, v] = c.w[e], 1
    for k in range(c.n):
        way, far = d[:, k, None] + d[None, k, :], hops[:, k, None] + hops[None, k, :]
        better = (way < d) | ((way == d) & (far < hops))
        d, hops = np.where(better, way, d), np.where(better, far, hops)
    bad = np.diag(d) < 0
    s, t = np.nonzero(np.isfinite(d))
    return frame(g, [(c.ids[a], c.ids[b], float(d[a, b]), int(hops[a, b]), bool(bad[a])) for a, b in zip(s.tolist(), t.tolist(), strict=True)], "source long, target long, distance double, hops long, negative boolean")


class Labels:
    """Exact distances by pruned landmark labels: hubs in order of degree, each searched only where earlier hubs don't explain the distance."""

    def __init__(self, g: Graph):
        self.g, self.csr = g, collect(g)
        c = self.csr
        self.hub: list[dict[int, int]] = [{} for _ in range(c.n)]
        self.rank = np.lexsort((np.arange(c.n), -c.degree()))
        for h in self.rank.tolist():
            self._spread(h, h, 0)
        self.extra: list[tuple[int, int]] = []

    def _query(self, u: int, v: int) -> int:
        a, b = self.hub[u], self.hub[v]
        if len(a) > len(b):
            a, b = b, a
        return min((d + b[h] for h, d in a.items() if h in b), default=1 << 60)

    def _around(self, u: int) -> list[int]:
        return self.csr.out(u).tolist() + [b for a, b in self.extra if a == u] + [a for a, b in self.extra if b == u] if hasattr(self, "extra") else self.csr.out(u).tolist()

    def _spread(self, hub: int, start: int, hop: int) -> None:
        front, seen = [start], {start}
        while front:
            new = []
            for u in front:
                if self._query(hub, u) <= hop and not (u == hub and hop == 0):
                    continue
                self.hub[u][hub] = hop
                for v in self._around(u):
                    if v not in seen:
                        seen.add(v)
                        new.append(v)
            front, hop = new, hop + 1

    def insert(self, u: int, v: int) -> None:
        """One more edge of an undirected graph: the hubs of either end search on from the other."""
        a, b = self.csr.index([u, v])
        self.extra.append((a, b))
        for x, y in ((a, b), (b, a)):
            for h, d in sorted(self.hub[x].items(), key=lambda i: i[1]):
                self._spread(h, y, d + 1)

    def distance(self, u: int, v: int) -> int | None:
        a, b = self.csr.index([u, v])
        d = self._query(a, b)
        return None if d >= 1 << 60 else d

    def table(self) -> DataFrame:
        """(node, hub, distance)."""
        ids = self.csr.ids
        return frame(self.g, [(ids[u], ids[h], d) for u, x in enumerate(self.hub) for h, d in x.items()], "node long, hub long, distance int")


def label_distances(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, distance) of pairs(u, v): the least sum over common hubs; pairs without one are left out."""
    a, b = (labels.select(F.col("node").alias(c), "hub", F.col("distance").alias(d)) for c, d in (("u", "x"), ("v", "y")))
    return pairs.select("u", "v").join(a, "u").join(b, ["v", "hub"]).groupBy("u", "v").agg(F.min(F.col("x") + F.col("y")).alias("distance"))


# measures of the whole graph


def neighbourhood_function(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(distance, pairs): ordered pairs of different nodes at most so far apart, over sources(id) or all."""
    counts = reach_counts(g, sources).where("hop > 0").groupBy(F.col("hop").alias("distance")).agg(F.sum("nodes").alias("k"))
    upto = Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)  # one row per distance
    return counts.select("distance", F.sum("k").over(upto).alias("pairs"))


def sampled_neighbourhood_function(g: Graph, k: int, seed: int = 1) -> DataFrame:
    """The same, scaled up from k sampled sources."""
    n = g.vertices.count()
    some = g.vertices.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("id")
    return neighbourhood_function(g, some).select("distance", (F.col("pairs") * n / max(min(k, n), 1)).alias("pairs"))


def effective_diameter(g: Graph, ratio: float = 0.9) -> DataFrame:
    """One row: the mean over nodes of the least hops within which ratio of all nodes lie, the node itself included; nodes that reach fewer are left out."""
    need = math.ceil(ratio * g.vertices.count())
    return first_within(g, need).agg(F.avg("hops").alias("effective_diameter"))


def _sketched(g: Graph, k: int, r: int, seed: int, rounds: int) -> list[DataFrame]:
    """Rows (node, masks) after 0, 1, 2, ... hops: k bit masks, in which random bits of all nodes within reach are set."""
    bits = int(g.vertices.count()).bit_length() + r
    u = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    bit = lambda i: F.least(F.floor(-F.log2(u(i) + 1e-12)), F.lit(min(bits, 60))).cast("int")
    state = materialize(g.vertices.select("id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), bit(i))).alias("m")), "anf")
    arcs = materialize(g.arcs().where("u <> v").select("u", "v"), "arcs")
    out = [state]
    # masks are many times larger than their files, by which Spark would choose to broadcast them: no join may
    for _ in range(rounds):
        cols = [F.bit_or(F.col("m")[i]).alias(f"b{i}") for i in range(k)]
        near = arcs.join(state.withColumnRenamed("id", "v").hint("merge"), "v").groupBy(F.col("u").alias("id")).agg(*cols).select("id", F.array(*(f"b{i}" for i in range(k))).alias("near"))
        new = materialize(state.join(near.hint("merge"), "id", "left").select("id", F.when(F.col("near").isNull(), F.col("m")).otherwise(F.zip_with("m", "near", lambda a, b: a.bitwiseOR(b))).alias("m")), "anf")
        out.append(new)
        if new.join(state.withColumnRenamed("m", "before").hint("merge"), "id").where(~F.col("m").eqNullSafe(F.col("before"))).isEmpty():
            break
        state = new
    return out


def _estimate() -> F.Column:
    """Nodes within reach by the mean least unset bit."""
    unset = F.transform("m", lambda x: F.length(F.regexp_extract(F.reverse(F.bin(x)), "^(1*)", 1)))
    mean = F.aggregate(unset, F.lit(0.0), lambda a, x: a + x) / F.size("m")
    return F.pow(F.lit(2.0), mean) / 0.77351


def approximate_neighbourhood_function(g: Graph, k: int = 64, r: int = 7, seed: int = 1, rounds: int = 64) -> DataFrame:
    """(distance, pairs): ordered pairs within so many hops, nodes with themselves included, by bit masks that are or-ed along the arcs."""
    out = None
    for h, state in enumerate(_sketched(g, k, r, seed, rounds)):
        row = state.agg(F.lit(h).alias("distance"), F.sum(_estimate()).alias("pairs"))
        out = row if out is None else out.union(row)
    return out


def hop_plot(g: Graph, k: int = 64, r: int = 7, seed: int = 1, rounds: int = 64) -> DataFrame:
    """(distance, share): pairs within so many hops over those within any."""
    p = materialize(approximate_neighbourhood_function(g, k, r, seed, rounds), "anf-sums")
    top = p.agg(F.max("pairs").alias("top"))
    return p.join(F.broadcast(top)).select("distance", (F.col("pairs") / F.col("top")).alias("share"))


def approximate_effective_diameter(g: Graph, ratio: float = 0.9, k: int = 64, r: int = 7, seed: int = 1) -> DataFrame:
    """One row: the hops within which the estimate of a node reaches ratio of its last, averaged over nodes."""
    states = _sketched(g, k, r, seed, 64)
    last = states[-1].select("id", _estimate().alias("all"))
    within = None
    for h, s in enumerate(states):
        rows = s.select("id", F.lit(h).alias("h"), _estimate().alias("e"))
        within = rows if within is None else within.union(rows)
    first = within.join(last, "id").where(F.col("e") >= ratio * F.col("all")).groupBy("id").agg(F.min("h").alias("h"))
    return first.agg(F.avg("h").alias("effective_diameter"))


def diameter_range(g: Graph, error: float = 0.0) -> DataFrame:
    """One row (lower, upper) of the diameter in hops of the largest component, upper <= (1 + error) lower: breadth-first searches from nodes that the bounds leave open."""
    c = collect(g)
    left = np.zeros(c.n, dtype=bool)
    comp = np.full(c.n, -1)
    for u in range(c.n):
        if comp[u] < 0:
            comp[c.bfs([u]) >= 0] = u
    if c.n:
        left = comp == np.bincount(comp).argmax()
    low, up = np.zeros(c.n), np.full(c.n, np.inf)
    lower, upper, pick_far = 0, np.inf, True
    while left.any():
        at = np.flatnonzero(left)
        u = at[np.argmax(up[at] * c.n + c.degree()[at])] if pick_far and np.isfinite(up[at]).all() else at[np.argmin(low[at] * c.n - c.degree()[at])]
        pick_far = not pick_far
        d = c.bfs([int(u)])
        ecc = int(d.max())
        lower = max(lower, ecc)
        near = d >= 0
        low[near] = np.maximum(low[near], np.maximum(d[near], ecc - d[near]))
        up[near] = np.minimum(up[near], ecc + d[near])
        left[u] = False
        left &= up > lower * (1 + error)
        upper = max(lower, up[left].max()) if left.any() else max(lower, int(lower * (1 + error)) if error else lower)
    return frame(g, [(int(lower), int(upper) if np.isfinite(upper) else int(lower))], "lower long, upper long")


def mean_ball(g: Graph, radius: float, samples: int | None = None, seed: int = 1, weighted: bool = False) -> DataFrame:
    """One row: nodes within radius of a centre, averaged over sampled centres or all."""
    some = None if samples is None else g.vertices.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(samples).select("id")
    if not weighted:
        if samples is None and not g.directed and radius >= 2:
            return ball_total(g, int(radius)).select(F.try_divide(F.col("nodes").cast("double"), F.lit(float(g.vertices.count()))).alias("nodes"))
        return reach_counts(g, some, int(radius)).groupBy("source").agg(F.sum("nodes").alias("k")).agg(F.avg("k").alias("nodes"))

    def run(c: Csr, u: int) -> list[tuple]:
        return [(int((c.dijkstra([u])[0] <= radius).sum()),)]

    return per_source(g, some, run, "k long").agg(F.avg("k").alias("nodes"))


def reachable_nodes(g: Graph) -> DataFrame:
    """(node, reachable): how many nodes each reaches, itself included. Undirected: the component's size; directed: per source."""
    if not g.directed:
        c = materialize(connected_components(g), "comp")
        return c.join(c.groupBy("component").agg(F.count("*").alias("reachable")), "component").select("node", "reachable")
    return reach_counts(g).groupBy(F.col("source").alias("node")).agg(F.sum("nodes").alias("reachable"))


def adamic_adar_distance(g: Graph) -> DataFrame:
    """(src, dst, distance): 1 over the sum of 1 / ln(degree) of common neighbours; infinite without any."""
    from graphloom.operators.similarity import common_neighbours

    c = common_neighbours(g, g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return c.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.when(F.col("adamic_adar") > 0, 1 / F.col("adamic_adar")).otherwise(F.lit(float("inf"))).alias("distance"))


def algebraic_loads(g: Graph, systems: int = 10, rounds: int = 30, omega: float = 0.5, seed: int = 1) -> DataFrame:
    """(node, x): one load per system, random at first, then mixed with the weighted mean of the neighbours' and stretched to [0, 1] at the end."""
    start = F.transform(F.sequence(F.lit(0), F.lit(systems - 1)), lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40))
    arcs, state = materialize(g.arcs().where("u <> v"), "arcs"), materialize(g.vertices.select("id", start.alias("x")), "loads")
    for _ in range(rounds):
        cols = [(F.sum(F.col("w") * F.col("x")[i]) / F.sum("w")).alias(f"s{i}") for i in range(systems)]
        near = arcs.join(state.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(*cols).select("id", F.array(*(f"s{i}" for i in range(systems))).alias("near"))
        new = materialize(state.join(near, "id", "left").select("id", F.when(F.col("near").isNull(), F.col("x")).otherwise(F.zip_with("x", "near", lambda a, b: (1 - omega) * a + omega * b)).alias("x")), "loads")
        discard(state)
        state = new
    ends = state.agg(*(F.min(F.col("x")[i]).alias(f"a{i}") for i in range(systems)), *(F.max(F.col("x")[i]).alias(f"b{i}") for i in range(systems)))
    scaled = [F.when(F.col(f"b{i}") > F.col(f"a{i}"), (F.col("x")[i] - F.col(f"a{i}")) / (F.col(f"b{i}") - F.col(f"a{i}"))).otherwise(0.0) for i in range(systems)]
    return state.join(F.broadcast(ends)).select(F.col("id").alias("node"), F.array(*scaled).alias("x"))


def algebraic_distance(g: Graph, pairs: DataFrame | None = None, systems: int = 10, rounds: int = 30, omega: float = 0.5, norm: int = 0, seed: int = 1) -> DataFrame:
    """(u, v, distance) of pairs, by default edges: the norm-th mean difference of loads, norm 0 being the largest."""
    x = materialize(algebraic_loads(g, systems, rounds, omega, seed), "loads")
    p = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")) if pairs is None else pairs.select("u", "v")
    diff = F.zip_with("a", "b", lambda a, b: F.abs(a - b))
    d = F.array_max(diff) if norm == 0 else F.pow(F.aggregate(diff, F.lit(0.0), lambda s, y: s + F.pow(y, F.lit(norm))), F.lit(1.0 / norm))
    return p.join(x.select(F.col("node").alias("u"), F.col("x").alias("a")), "u").join(x.select(F.col("node").alias("v"), F.col("x").alias("b")), "v").select("u", "v", d.alias("distance"))


def commute_distance(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(u, v, distance) of pairs, by default edges: root of effective resistance times volume."""
    from graphloom.operators.resistance import resistances

    g = g.materialized()
    volume = g.edges.where("src <> dst").agg(2 * F.sum("weight")).first()[0] or 0.0
    p = materialize(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")) if pairs is None else pairs.select("u", "v"), "pairs")
    r = resistances(g, p.distinct())
    return p.join(r, ["u", "v"]).select("u", "v", F.sqrt(F.greatest("r", F.lit(0.0)) * volume).alias("distance"))


# components; biconnected ones are in blocks


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def largest_component(g: Graph) -> Graph:
    from graphloom.operators.structure import subgraph

    c = materialize(connected_components(g), "comp")
    top = component_sizes(c).orderBy(F.desc("size"), "component").limit(1)
    return subgraph(g, c.join(F.broadcast(top), "component", "left_semi").select(F.col("node").alias("id")))


def merged_components(components: DataFrame, new_edges: DataFrame) -> DataFrame:
    """components (node, component) after edges (src, dst) came: only the components that they join are relabelled."""
    from graphloom.operators.components import star_components

    c = lambda x, n: components.select(F.col("node").alias(x), F.col("component").alias(n))
    joined = new_edges.select("src", "dst").join(c("src", "a"), "src").join(c("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    to = star_components(joined).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return components.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def split_components(g: Graph, components: DataFrame, removed: DataFrame) -> DataFrame:
    """components after edges (src, dst) went; g is what is left. Only the components that lost an edge are searched again."""
    from graphloom.operators.components import star_components

    hit = removed.select(F.explode(F.array("src", "dst")).alias("node")).join(components, "node").select("component").distinct()
    open_ = materialize(components.join(hit, "component", "left_semi").select("node"), "open")
    e = g.edges.join(open_.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")
    fresh = open_.join(star_components(e), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return components.join(hit, "component", "left_anti").select("node", "component").union(fresh)


def relaxed(g: Graph, distances: DataFrame, new_edges: DataFrame, weighted: bool = True) -> DataFrame:
    """distances (node, distance) after edges (src, dst, weight) came or became lighter; g holds them. Rounds start from their ends alone."""
    w = F.col("weight") if weighted else F.lit(1.0)
    e = new_edges.select("src", "dst", w.alias("w"))
    ends = e.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")
    ends = ends if g.directed else ends.union(e.select("dst", "src", "w"))
    arcs = materialize(g.arcs().select("u", "v", F.col("w") if weighted else F.lit(1.0).alias("w")), "arcs")
    best = materialize(distances.select("node", F.col("distance").cast("double").alias("distance")), "dyn")
    step = ends
    while True:
        offer = step.join(best.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        new = materialize(offer.join(best, "node", "left").where("distance IS NULL OR offer < distance").select("node", F.col("offer").alias("distance")), "dyn-new")
        if new.isEmpty():
            return best
        best = materialize(best.join(new.select("node"), "node", "left_anti").union(new), "dyn")
        step = arcs.join(new.select(F.col("node").alias("u")), "u", "left_semi")


def relaxed_pairs(apsp_rows: DataFrame, u: int, v: int, w: float, directed: bool = False) -> DataFrame:
    """All distances (source, target, distance) after edge u-v of weight w came or became lighter: d(a, u) + w + d(v, b), one join."""
    d = apsp_rows.select("source", "target", "distance")
    out = None
    for a, b in ((u, v),) if directed else ((u, v), (v, u)):
        into = d.where(F.col("target") == a).select("source", F.col("distance").alias("x"))
        from_ = d.where(F.col("source") == b).select("target", F.col("distance").alias("y"))
        # one row per node that reaches a, and one per node that b reaches: all their pairs are distances that may change
        way = into.withColumn("_k", F.lit(1)).join(F.broadcast(from_.withColumn("_k", F.lit(1))), "_k").select("source", "target", (F.col("x") + w + F.col("y")).alias("distance"))
        out = way if out is None else out.union(way)
    return d.union(out).groupBy("source", "target").agg(F.min("distance").alias("distance"))


def affected_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, before, after): nodes whose distance an event changed; null where there was or is none."""
    b, a = before.select("node", F.col("distance").alias("before")), after.select("node", F.col("distance").alias("after"))
    return b.join(a, "node", "full").where(~F.col("before").eqNullSafe(F.col("after")))


def random_spanning_forest(g: Graph, seed: int = 1) -> DataFrame:
    """(src, dst): a uniform spanning tree of every component, by loop-erased random walks. On the driver."""
    c = collect(g)
    rows = [(c.ids[max(a, b)], c.ids[min(a, b)]) for a, b in uniform_tree(c, np.random.default_rng(seed))]
    return frame(g, sorted(rows), "src long, dst long")


def uniform_tree(c: Csr, rng: np.random.Generator) -> list[tuple[int, int]]:
    inside, out = np.zeros(c.n, dtype=bool), []
    total = [np.cumsum(c.weights(u)) for u in range(c.n)]
    comp = np.full(c.n, -1)
    for u in range(c.n):
        if comp[u] < 0:
            comp[c.bfs([u]) >= 0] = u
            inside[u] = True
    for start in range(c.n):
        nxt, u = {}, start
        while not inside[u]:
            x = c.out(u)[min(int(np.searchsorted(total[u], rng.random() * total[u][-1], "right")), len(total[u]) - 1)]
            nxt[u] = int(x)
            u = nxt[u]
        u = start
        while not inside[u]:
            inside[u] = True
            out.append((u, nxt[u]))
            u = nxt[u]
    return out
