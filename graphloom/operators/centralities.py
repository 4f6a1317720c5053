"""Centralities of paths, walks, currents and groups. Per-source work runs in tasks over a broadcast graph of checked size; sums are aggregations."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels.csr import Csr, collect, frame, per_source
from graphloom.operators.distances import betweenness
from graphloom.operators.multisource import group_closeness, pivot_sums, reach_counts, top_closeness  # noqa: F401
from graphloom.operators.structure import degrees
from graphloom.plans.scratch import discard, materialize


def _all_nodes(g: Graph, scores: DataFrame) -> DataFrame:
    return g.vertices.select(F.col("id").alias("node")).join(scores, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def _levels(c: Csr, s: int, target: int | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Hops from s (-1 where none leads), shortest path counts, and level by level the arcs (from, to, edge) by which nodes are first reached; up to the target's level, if one is given."""
    dist, count, steps = np.full(c.n, -1, dtype=np.int64), np.zeros(c.n), []
    dist[s], count[s], front = 0, 1, np.array([s])
    while len(front) and (target is None or dist[target] < 0):
        k = c.ptr[front + 1] - c.ptr[front]
        at = np.repeat(c.ptr[front] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        u, at = np.repeat(front, k)[fresh := dist[c.nbr[at]] < 0], at[fresh]
        v = c.nbr[at]
        front, inverse = np.unique(v, return_inverse=True)
        dist[front], count[front] = len(steps) + 1, np.bincount(inverse.reshape(-1), count[u], len(front))
        steps.append((u, v, c.eid[at]))
    return dist, count, steps


def _search(c: Csr, s: int) -> tuple[list[int], list[list[tuple[int, int]]], np.ndarray]:
    """Nodes by rising distance by weight, (predecessor, edge) lists, and shortest path counts."""
    preds: list[list[tuple[int, int]]] = [[] for _ in range(c.n)]
    count, order = np.zeros(c.n), []
    count[s] = 1
    dist = np.full(c.n, np.inf)
    dist[s] = 0
    heap, done = [(0.0, s)], np.zeros(c.n, dtype=bool)
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        order.append(u)
        for v, e, w in zip(c.out(u).tolist(), c.edges_of(u).tolist(), c.weights(u).tolist(), strict=True):
            if v == u:
                continue
            if dist[u] + w < dist[v] - 1e-12:
                dist[v], count[v], preds[v] = dist[u] + w, count[u], [(u, e)]
                heapq.heappush(heap, (dist[v], v))
            elif abs(dist[u] + w - dist[v]) <= 1e-12 and not done[v]:
                count[v] += count[u]
                preds[v].append((u, e))
    return order, preds, count


def _dependencies(g: Graph, sources: DataFrame | None, weighted: bool, edges: bool, csr: Csr | None = None) -> DataFrame:
    """(key, score) summed over sources: key is a node, or an edge number; a task adds up its own sources."""
    import pandas as pd

    spark = g.vertices.sparkSession
    ship = spark.sparkContext.broadcast(csr or collect(g))
    chosen = g.vertices.select("id") if sources is None else sources.select("id").distinct().join(g.vertices, "id", "left_semi")

    def run(frames):
        c = ship.value
        total = np.zeros(c.m if edges else c.n)
        for f in frames:
            for s in c.index(f["id"].tolist()):
                own = np.zeros(c.n)
                if weighted:
                    order, preds, count = _search(c, s)
                    for v in reversed(order):
                        for u, e in preds[v]:
                            x = count[u] / count[v] * (1 + own[v])
                            own[u] += x
                            if edges:
                                total[e] += x
                else:
                    _, count, steps = _levels(c, s)
                    for u, v, e in reversed(steps):
                        x = count[u] / count[v] * (1 + own[v])
                        np.add.at(own, u, x)
                        if edges:
                            np.add.at(total, e, x)
                if not edges:
                    own[s] = 0
                    total += own
        at = np.flatnonzero(total)
        yield pd.DataFrame({"key": at if edges else c.ids[at], "x": total[at]})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return chosen.repartition(parts, "id").mapInPandas(run, "key long, x double").groupBy("key").agg(F.sum("x").alias("score"))


def weighted_betweenness(g: Graph, normalized: bool = False, sources: DataFrame | None = None, weighted: bool = True) -> DataFrame:
    """(node, score) over ordered pairs, paths by weight; over (n - 1)(n - 2) if normalized."""
    n = g.vertices.count()
    scale = 1 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    return _all_nodes(g, _dependencies(g, sources, weighted, False).select(F.col("key").alias("node"), (F.col("score") * scale).alias("score")))


def edge_betweenness(g: Graph, normalized: bool = False, weighted: bool = False) -> DataFrame:
    """(src, dst, score) over ordered pairs; over n (n - 1) if normalized."""
    c = collect(g)
    scale = 1 / (c.n * (c.n - 1)) if normalized and c.n > 1 else 1.0
    name = g.vertices.sparkSession.createDataFrame(pa.table({"key": pa.array(np.arange(c.m)), "src": pa.array(c.ids[c.src], pa.int64()), "dst": pa.array(c.ids[c.dst], pa.int64())}))
    d = _dependencies(g, None, weighted, True, c)
    return name.join(d, "key", "left").select("src", "dst", (F.coalesce("score", F.lit(0.0)) * scale).alias("score"))


def estimate_betweenness(g: Graph, samples: int, normalized: bool = False, seed: int = 1) -> DataFrame:
    """(node, score) from sampled sources, scaled to all."""
    return betweenness(g, normalized, g.vertices.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(samples).select("id"))


def _ship(g: Graph, c: Csr) -> Broadcast:
    return g.vertices.sparkSession.sparkContext.broadcast(c)


def _diameter_bound(c: Csr) -> int:
    """Twice the hops from some node of the largest component, plus 1: no shortest path has more nodes."""
    if not c.n:
        return 1
    best, seen = 0, c.degree() == 0
    for u in range(c.n):
        if not seen[u]:
            d = c.bfs([u])
            seen |= d >= 0
            best = max(best, int(d.max()))
    return 2 * best + 1


def _sampled_paths(g: Graph, r: int, seed: int, first: int = 0, ship: Broadcast | None = None) -> DataFrame:
    """(sample, node): inner nodes of one random shortest path between the ends of each of r random pairs; a task counts its own. ship: the graph, if it is broadcast already."""
    spark = g.vertices.sparkSession
    ship = ship or spark.sparkContext.broadcast(collect(g))
    c = ship.value
    import pandas as pd

    def run(frames):
        c = ship.value
        back = c.reversed()
        for f in frames:
            rows = []
            for i in f["id"].tolist():
                rng = np.random.default_rng([seed, i])
                s, t = rng.choice(c.n, 2, replace=False)
                dist, count, _ = _levels(c, int(s), int(t))
                v = int(t)
                while count[v] and v != s:
                    near = back.out(v)
                    near = near[dist[near] == dist[v] - 1]
                    p = np.cumsum(count[near])
                    v = int(near[min(int(np.searchsorted(p, rng.random() * p[-1], "right")), len(near) - 1)])
                    if v != s:
                        rows.append((i, int(c.ids[v])))
            yield pd.DataFrame(rows, columns=["sample", "node"])

    return spark.range(first, first + (r if c.n > 1 else 0)).mapInPandas(run, "sample long, node long")


def approx_betweenness(g: Graph, epsilon: float = 0.1, delta: float = 0.1, constant: float = 1.0, seed: int = 1) -> DataFrame:
    """(node, score): share of sampled shortest paths a node is inside of; off by more than epsilon with probability delta at most."""
    c = collect(g)
    vd = _diameter_bound(c)
    r = int(np.ceil(constant / epsilon**2 * (np.floor(np.log2(max(vd - 2, 1))) + 1 - np.log(delta))))
    hits = _sampled_paths(g, r, seed, ship=_ship(g, c)).groupBy("node").agg((F.count("*") / r).alias("score"))
    return _all_nodes(g, hits)


def kadabra_betweenness(g: Graph, epsilon: float = 0.05, delta: float = 0.1, k: int | None = None, seed: int = 1) -> DataFrame:
    """(node, score) by adaptive sampling: batches of paths until the confidence bounds of all nodes (of the k-th and the next, if k is given) are close enough. With k, the k best."""
    c = collect(g)
    vd, ship = _diameter_bound(c), _ship(g, c)
    most = int(np.ceil(0.5 / epsilon**2 * (np.floor(np.log2(max(vd - 2, 1))) + 1 + np.log(2 / delta))))
    n, took, hits = c.n, 0, None
    size = max(most // 8, 50)
    while took < most:
        some = min(size, most - took)
        new = materialize(_sampled_paths(g, some, seed, took, ship).groupBy("node").agg(F.count("*").alias("c")), "paths")
        hits = new if hits is None else materialize(hits.union(new).groupBy("node").agg(F.sum("c").alias("c")), "paths")
        took += some
        log = float(np.log(2 * max(n, 1) * max(most // size, 1) / delta))
        p = F.col("c") / took
        width = F.sqrt(2 * p * (1 - p) * log / took) + 3 * log / took
        if k is None:
            done = hits.agg(F.max(width)).first()[0]
            if done is not None and done <= epsilon:
                break
        else:
            top = hits.select(p.alias("p"), width.alias("w")).orderBy(F.desc("p")).limit(k + 1).collect()
            if len(top) <= k or top[k - 1]["p"] - top[k - 1]["w"] >= top[k]["p"] + top[k]["w"]:
                break
    scored = hits.select("node", (F.col("c") / took).alias("score")) if hits is not None else g.vertices.select(F.col("id").alias("node"), F.lit(0.0).alias("score")).where("false")
    out = _all_nodes(g, scored)
    return out if k is None else out.orderBy(F.desc("score"), "node").limit(k)


def _hung(c: Csr) -> Csr:
    """An undirected graph without its leaves (of an edge between two, the larger), which stay as hung = (at, weight, count, first, ids): classes of leaves of one weight at one node of the rest, each with its place in ids, and where each node's classes begin."""
    on = c.row != c.nbr
    lo, hi, w = np.full(c.n, c.n), np.full(c.n, -1), np.full(c.n, np.inf)
    np.minimum.at(lo, c.row[on], c.nbr[on])
    np.maximum.at(hi, c.row[on], c.nbr[on])
    np.minimum.at(w, c.row[on], c.w[on])
    one = (lo == hi) & (not c.directed)
    leaf = one & ~(one[hi] & (np.arange(c.n) < hi))
    at, rest = np.flatnonzero(leaf), ~(leaf[c.src] | leaf[c.dst])
    core = Csr(c.ids[~leaf], c.ids[c.src[rest]], c.ids[c.dst[rest]], c.weight[rest], c.directed)
    node = np.searchsorted(core.ids, c.ids[hi[at]])
    order = np.lexsort((at, w[at], node))
    at, node, w = at[order], node[order], w[at[order]]
    new = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (w[1:] != w[:-1]))) if len(at) else at
    core.hung = (node[new], w[new], np.diff(np.append(new, len(at))), new, c.ids[at])
    return core


def weighted_closeness(g: Graph, normalized: bool = True, generalized: bool = True, harmonic: bool = False) -> DataFrame:
    """(node, score) with distances by weight: closeness, or the sum of 1 / distance. Leaves are not searched from: one of weight w is w farther from all others than its neighbour is, and leaves of one weight at one node score the same."""
    whole = collect(g)
    n, core = whole.n, _hung(whole)

    def score(d: np.ndarray, many: np.ndarray) -> float:
        if harmonic:
            some = (d > 0) & (many > 0)
            s = float((many[some] / d[some]).sum())
            return s / (n - 1) if normalized and n > 1 else s
        total, reached = float((d * many).sum()), int(many.sum())
        if not total:
            return 0.0
        return (reached - 1) / total / (n - 1) * ((reached - 1) if normalized else 1) if generalized else ((n - 1) if normalized else 1) / total

    def run(c: Csr, u: int) -> list[tuple]:
        at, w, count, first, ids = c.hung
        d = c.dijkstra([u])[0]
        near, held = np.flatnonzero(np.isfinite(d)), np.flatnonzero(np.isfinite(d[at]))
        far, many = np.concatenate([d[near], d[at[held]] + w[held]]), np.concatenate([np.ones(len(near), dtype=np.int64), count[held]])
        rows = [(int(c.ids[u]), score(far, many))]
        for i in np.flatnonzero(at[held] == u):
            k, x = held[i], len(near) + i
            to = np.append(far + w[k], 0.0)  # the leaf itself is at 0, not one of its class
            left = np.append(many, 1)
            left[x] -= 1
            s = score(to, left)
            rows += [(v, s) for v in ids[first[k] : first[k] + count[k]].tolist()]
        return rows

    sources = g.vertices.sparkSession.createDataFrame(pa.table({"id": pa.array(core.ids, pa.int64())}))
    return per_source(g, sources, run, "node long, score double", core)


def approx_closeness(g: Graph, samples: int, normalized: bool = False, seed: int = 1) -> DataFrame:
    """(node, score): 1 over the estimated sum of distances, exact at sampled pivots; far nodes take their nearest pivot's sum, near ones a scaled one. Connected undirected graphs."""
    n = g.vertices.count()
    some = materialize(g.vertices.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(samples).select("id"), "pivots")
    rows = materialize(pivot_sums(g, some), "pivot-sums")
    own = reach_counts(g, some).groupBy(F.col("source").alias("nearest")).agg(F.sum(F.col("hop") * F.col("nodes")).alias("exact"))
    near = rows.join(own, "nearest")
    # the mean of two estimates: the pivots' distances scaled up, and the nearest pivot's exact sum
    total = F.when(F.col("hops") == 0, F.col("exact")).otherwise((F.col("total") * n / F.col("pivots") + F.col("exact")) / 2)
    return near.select("node", F.when(total > 0, (n - 1 if normalized else 1) / total).otherwise(0.0).alias("score"))


def k_path(g: Graph, alpha: float = 0.2, k: int | None = None, seed: int = 1) -> DataFrame:
    """(node, score): how often random simple walks of up to k steps pass a node, k n times the share; walks are dealt out."""
    import pandas as pd

    c = collect(g)
    n = max(c.n, 2)
    k = k or max(int(np.log(n + c.m)), 1)
    t = int(2 * k * k * n ** (1 - 2 * alpha) * np.log(n)) + 1
    spark = g.vertices.sparkSession
    ship = spark.sparkContext.broadcast(c)

    def run(frames):
        c = ship.value
        for f in frames:
            hits = np.zeros(c.n, dtype=np.int64)
            for i in f["id"].tolist():
                rng = np.random.default_rng([seed, i])
                u, seen = int(rng.integers(c.n)), set()
                for _ in range(int(rng.integers(1, k + 1))):
                    seen.add(u)
                    near = [(v, 1 / w) for v, w in zip(c.out(u).tolist(), c.weights(u).tolist(), strict=True) if v not in seen]
                    if not near:
                        break
                    p = np.cumsum([x for _, x in near])
                    u = near[min(int(np.searchsorted(p, rng.random() * p[-1], "right")), len(near) - 1)][0]
                    hits[u] += 1
            at = np.flatnonzero(hits)
            yield pd.DataFrame({"node": c.ids[at], "c": hits[at]})

    sums = spark.range(t).mapInPandas(run, "node long, c long").groupBy("node").agg((F.sum("c") * float(k * n) / t).alias("score"))
    return _all_nodes(g, sums)


def permanence(g: Graph, p: DataFrame) -> DataFrame:
    """(node, score): own-community neighbours over the most in another one and the degree, less (1 - clustering among own neighbours)."""
    arcs = materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "arcs")
    c = lambda x, n: p.select(F.col("node").alias(x), F.col("community").alias(n))
    a = materialize(arcs.join(c("u", "a"), "u").join(c("v", "b"), "v"), "labelled")
    per = a.groupBy("u", "a", "b").agg(F.count("*").alias("k"))
    s = per.groupBy("u").agg(F.coalesce(F.max(F.when(F.col("a") == F.col("b"), F.col("k"))), F.lit(0)).alias("own"), F.coalesce(F.max(F.when(F.col("a") != F.col("b"), F.col("k"))), F.lit(1)).alias("other"), F.sum("k").alias("d"))
    inner = a.where("a = b").select("u", "v")
    wedge = inner.where("u > v").select(F.col("u").alias("x"), F.col("v").alias("y"))
    closed = wedge.join(inner.select(F.col("u").alias("x"), F.col("v").alias("m")), "x").join(inner.select(F.col("u").alias("y"), F.col("v").alias("m")), ["y", "m"]).groupBy(F.col("m").alias("u")).agg(F.count("*").alias("t"))
    pairs = F.col("own") * (F.col("own") - 1) / 2
    cluster = F.when(F.col("own") > 1, F.coalesce("t", F.lit(0)) / pairs).otherwise(0.0)
    out = s.join(closed, "u", "left").select(F.col("u").alias("node"), (F.col("own") / F.greatest("other", F.lit(1)) / F.col("d") - (1 - cluster)).alias("score"))
    return p.select("node").join(out, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def local_partition_coverage(g: Graph, p: DataFrame) -> DataFrame:
    """(node, score): weight to the own community over all weight; 0 without edges."""
    c = lambda x, n: p.select(F.col("node").alias(x), F.col("community").alias(n))
    a = g.arcs().join(c("u", "a"), "u").join(c("v", "b"), "v")
    s = a.groupBy(F.col("u").alias("node")).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("score"))
    return _all_nodes(g, s)


def square_clustering(g: Graph) -> DataFrame:
    """(node, score): over pairs v < w of neighbours, squares closed over squares possible."""
    arcs = materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "arcs")
    d = materialize(arcs.groupBy("u").agg(F.count("*").alias("d")), "deg")
    b = arcs.withColumnsRenamed({"v": "b"})
    pairs = arcs.withColumnRenamed("v", "a").join(b, "u").where("a < b")
    both = materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("common")), "common")
    linked = arcs.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).alias("link"))
    deg = lambda x, n: d.select(F.col("u").alias(x), F.col("d").alias(n))
    q = pairs.join(both, ["a", "b"]).join(linked, ["a", "b"], "left").join(deg("a", "da"), "a").join(deg("b", "db"), "b")
    squares = F.col("common") - 1
    possible = F.col("da") + F.col("db") - F.col("common") - 1 - 2 * F.coalesce("link", F.lit(0))
    s = q.groupBy(F.col("u").alias("node")).agg(F.sum(squares).alias("s"), F.sum(possible).alias("p"))
    return _all_nodes(g, s.select("node", F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(0.0).alias("score")))


def complex_path_lengths(g: Graph, threshold: int = 3, start: int | None = None) -> DataFrame:
    """(start, node, round): a node catches once threshold of its neighbours (or all, if fewer) have; start's neighbourhood has from the beginning."""

    def run(c: Csr, u: int) -> list[tuple]:
        when, hits = np.full(c.n, -1), np.zeros(c.n, dtype=np.int64)
        front = np.unique(np.append(c.out(u), u))
        when[front], r = 0, 0
        when[u] = 0
        while len(front):
            r += 1
            for x in front.tolist():
                hits[c.out(x)] += 1
            front = np.flatnonzero((when < 0) & (hits >= np.minimum(threshold, np.maximum(c.degree(), 1))))
            when[front] = r
        return [(int(c.ids[u]), int(c.ids[v]), int(when[v])) for v in np.flatnonzero(when >= 0)]

    some = None if start is None else g.vertices.where(F.col("id") == start).select("id")
    return per_source(g, some, run, "start long, node long, round int")


# currents and trees


def spanning_edge(g: Graph) -> DataFrame:
    """(src, dst, score): effective resistance of each edge times its weight, the share of spanning trees it is in."""
    from graphloom.operators.resistance import resistances

    g = g.materialized()
    r = resistances(g, g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()).select(F.col("u").alias("src"), F.col("v").alias("dst"), "r")
    return g.edges.join(r, ["src", "dst"]).select("src", "dst", (F.col("r") * F.col("weight")).alias("score"))


def _trees(g: Graph, samples: int, seed: int) -> DataFrame:
    """(src, dst, c): how many of the sampled uniform spanning trees hold each edge; trees are dealt out."""
    import pandas as pd

    from graphloom.operators.paths import uniform_tree

    spark = g.vertices.sparkSession
    ship = spark.sparkContext.broadcast(collect(g))

    def run(frames):
        c = ship.value
        for f in frames:
            hits: dict[tuple[int, int], int] = {}
            for i in f["id"].tolist():
                for a, b in uniform_tree(c, np.random.default_rng([seed, i])):
                    key = (int(c.ids[max(a, b)]), int(c.ids[min(a, b)]))
                    hits[key] = hits.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in hits.items()], columns=["src", "dst", "c"])

    return spark.range(samples).mapInPandas(run, "src long, dst long, c long").groupBy("src", "dst").agg(F.sum("c").alias("c"))


def approx_spanning_edge(g: Graph, epsilon: float = 0.1, delta: float = 0.1, seed: int = 1) -> DataFrame:
    """(src, dst, score): share of sampled spanning trees that hold the edge, off by epsilon with probability delta an edge."""
    samples = int(np.ceil(np.log(2 / delta) / (2 * epsilon**2)))
    t = _trees(g, samples, seed)
    return g.edges.select("src", "dst").distinct().join(t, ["src", "dst"], "left").select("src", "dst", (F.coalesce("c", F.lit(0)) / samples).alias("score"))


def electrical_closeness(g: Graph, epsilon: float | None = None, seed: int = 1) -> DataFrame:
    """(node, score): n - 1 over the sum of effective resistances to all others. With epsilon the diagonal of the pseudo-inverse comes from sampled signs and a multilevel solver, else from a dense one."""
    from graphloom.kernels.spectral import laplacian, multilevel, pseudo_inverse

    if epsilon is None:
        lap, c = laplacian(g)
        diag = np.diag(pseudo_inverse(lap))
    else:
        c = collect(g)
        rng = np.random.default_rng(seed)
        root = int(np.argmax(c.degree()))
        e = np.zeros(c.n) - 1 / c.n
        e[root] += 1
        column = multilevel(c, e)
        # resistances to the root by random projections: r(u, root) = |B L+ (e_u - e_root)|²
        k, r = max(int(np.ceil(4 * np.log(max(c.n, 2)) / epsilon**2)), 8), np.zeros(c.n)
        for _ in range(min(k, 400)):
            sign = rng.choice([-1.0, 1.0], c.m) * np.sqrt(c.weight)
            b = np.bincount(c.src, sign, c.n) - np.bincount(c.dst, sign, c.n)
            z = multilevel(c, b)
            r += (z - z[root]) ** 2
        diag = r / min(k, 400) - column[root] + 2 * column
    score = (c.n - 1) / np.maximum(c.n * diag + diag.sum(), 1e-300) if c.n > 1 else np.zeros(c.n)
    return frame(g, list(zip(c.ids.tolist(), score.tolist(), strict=True)), "node long, score double")


def forest_closeness(g: Graph, kappa: float = 1.0) -> DataFrame:
    """(node, score): n over the sum of forest distances, from the inverse of I + kappa L; dense."""
    from graphloom.kernels.spectral import laplacian

    lap, c = laplacian(g)
    inv = np.linalg.inv(np.eye(c.n) + kappa * lap)
    diag = np.diag(inv)
    far = c.n * diag + diag.sum() - 2 * inv.sum(axis=1)
    return frame(g, list(zip(c.ids.tolist(), (c.n / np.maximum(far, 1e-300)).tolist(), strict=True)), "node long, score double")


# groups


def group_degree(g: Graph, k: int = 1, count_group: bool = True) -> DataFrame:
    """(position, node): greedily the nodes that reach most new neighbours; a round is one anti-join and one aggregation."""
    arcs = materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "arcs")
    own = g.vertices.select(F.col("id").alias("u"), F.col("id").alias("v"))
    open_ = materialize(arcs.union(own) if count_group else arcs, "open")
    chosen: list[tuple[int, int]] = []
    for i in range(k):
        taken = [n for _, n in chosen]
        best = open_.where(~F.col("u").isin(taken)).groupBy("u").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "u").first()
        if best is None:
            break
        chosen.append((i, best["u"]))
        hit = open_.where(F.col("u") == best["u"]).select("v")
        hit = hit if count_group else hit.union(g.vertices.where(F.col("id") == best["u"]).select("id"))
        new = materialize(open_.join(hit.distinct(), "v", "left_anti").select("u", "v"), "open")
        discard(open_)
        open_ = new
    return frame(g, chosen, "position int, node long")


def _group_gain(dist: np.ndarray, d: np.ndarray, n: int) -> float:
    """By how much a node with distances d lessens the sum of distances to the group, unreached nodes at n."""
    return float(np.maximum(np.where(dist < 0, n, dist) - np.where(d < 0, n, d), 0).sum())


def _score_of(dist: np.ndarray, harmonic: bool, n: int) -> float:
    if harmonic:
        return float(np.where(dist > 0, 1.0 / np.maximum(dist, 1), 0.0).sum())
    return -float(np.where(dist < 0, n, dist).sum())


def group_value(g: Graph, group: list[int], harmonic: bool = False) -> float:
    """n over the sum of distances to the group (unreached nodes at n), or the sum of 1 / distance."""
    c = collect(g)
    d = c.bfs(c.index(group))
    return _score_of(d, True, c.n) if harmonic else (c.n / max(-_score_of(d, False, c.n), 1e-300))


def local_search_group(g: Graph, group: list[int], swaps: int = 100, grow: int = 0, anywhere: bool = False) -> DataFrame:
    """(node): the group after swaps that lessen the sum of distances: a member for one of its neighbours, or for any node. grow: so many members are added before as many are taken off again, each the best, until nothing is gained. On the driver."""
    c = collect(g)
    own = c.index(group)
    value = lambda x: _score_of(c.bfs(x), False, c.n)
    best = value(own)
    for _ in range(swaps):
        found = None
        for u in list(own):
            others = range(c.n) if anywhere else c.out(u).tolist()
            for v in others:
                if v not in own:
                    new = [x for x in own if x != u] + [v]
                    s = value(new)
                    if s > best + 1e-9:
                        best, found = s, new
            if found:
                break
        if found is None and grow:
            new = list(own)
            for _ in range(grow):
                dist = c.bfs(new)
                out = [v for v in range(c.n) if v not in new]
                if out:
                    new.append(max(out, key=lambda v: _group_gain(dist, c.bfs([v]), c.n)))
            while len(new) > len(own):
                new.remove(max(new, key=lambda v: value([x for x in new if x != v])))
            if value(new) > best + 1e-9:
                best, found = value(new), new
        if found is None:
            break
        own = found
    return frame(g, [(c.ids[u],) for u in sorted(own)], "node long")


def approx_group_betweenness(g: Graph, k: int, epsilon: float = 0.1, delta: float = 0.1, seed: int = 1) -> DataFrame:
    """(position, node): greedily the nodes that lie on most sampled shortest paths not yet met."""
    n = max(g.vertices.count(), 2)
    r = int(np.ceil((np.log(2 / delta) + k * np.log(n)) / (2 * epsilon**2)))
    open_ = materialize(_sampled_paths(g, r, seed), "paths")
    chosen = []
    for i in range(k):
        best = open_.groupBy("node").agg(F.count_distinct("sample").alias("c")).orderBy(F.desc("c"), "node").first()
        if best is None:
            break
        chosen.append((i, best["node"]))
        open_ = materialize(open_.join(open_.where(F.col("node") == best["node"]).select("sample").distinct(), "sample", "left_anti"), "paths")
    return frame(g, chosen, "position int, node long")


def walk_group(g: Graph, k: int = 1, alpha: float | None = None, length: int = 12) -> DataFrame:
    """(position, node, score): greedily the group that most walks pass, walks of l steps counting alpha^l; each candidate's gain is counted in a task by products along the arcs."""
    c = collect(g)
    a = alpha if alpha is not None else 1.0 / (1 + int(c.degree().max() if c.n else 0))

    def missed(c: Csr, group: list[int]) -> float:
        free = np.ones(c.n)
        free[group] = 0
        x, total, f = free.copy(), 0.0, 1.0
        for _ in range(length):
            x = np.bincount(c.row, x[c.nbr], c.n) * free
            f *= a
            total += f * x.sum()
        return total

    chosen: list[int] = []
    rows = []
    everything = missed(c, [])
    for i in range(min(k, c.n)):
        now = list(chosen)
        top = per_source(g, None, lambda c, u, now=now: [] if u in now else [(u, missed(c, [*now, u]))], "row long, left double", c).orderBy("left", "row").first()
        chosen.append(top["row"])
        rows.append((i, c.ids[top["row"]], everything - top["left"]))
    return frame(g, rows, "position int, node long, score double")


def ranking(scores: DataFrame) -> DataFrame:
    """scores (node, score), largest first, ties by node."""
    return scores.orderBy(F.desc("score"), "node")


def centralization(scores: DataFrame) -> DataFrame:
    """One row: the sum of what scores fall short of the largest."""
    return scores.agg((F.max("score") * F.count("*") - F.sum("score")).alias("centralization"))


def rank_per_node(scores: DataFrame) -> DataFrame:
    """(node, rank) from 1 for the largest score, ties sharing the mean."""
    from graphloom.operators.toolbox import ranked

    r = ranked(scores.select("node", (-F.col("score")).alias("value")))
    return r.select("node", "rank")


def relative_rank_errors(one: DataFrame, other: DataFrame) -> DataFrame:
    """(node, error): rank in other over rank in one."""
    a, b = rank_per_node(one), rank_per_node(other).withColumnRenamed("rank", "r")
    return a.join(b, "node").select("node", (F.col("r") / F.col("rank")).alias("error"))


def top_katz(g: Graph, k: int, tol: float = 1e-9, rounds: int = 100) -> DataFrame:
    """(node, lower, upper): rounds until the k best are apart from the others by their bounds, walks of l steps counting alpha^l."""
    top = degrees(g).agg(F.max("degree")).first()[0] or 0
    alpha = 1.0 / (1 + top)
    arcs = materialize(g.arcs().select("u", "v"), "arcs")
    state = materialize(g.vertices.select("id", F.lit(1.0).alias("walks"), F.lit(0.0).alias("lower")), "katz")
    f = 1.0
    for _ in range(rounds):
        f *= alpha
        got = arcs.join(state.select(F.col("id").alias("v"), "walks"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("walks").alias("s"))
        new = materialize(state.join(got, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("walks"), (F.col("lower") + f * F.coalesce("s", F.lit(0.0))).alias("lower")), "katz")
        discard(state)
        state = new
        # each further step multiplies walks by top at most: a geometric series of ratio alpha * top
        bounded = state.select(F.col("id").alias("node"), "lower", (F.col("lower") + f * F.col("walks") * alpha * top / (1 - alpha * top)).alias("upper"))
        best = bounded.orderBy(F.desc("lower"), "node").limit(k + 1).collect()
        rest = bounded.orderBy(F.desc("upper")).limit(k + 1).collect()
        width = max((b["upper"] - b["lower"] for b in best), default=0.0)
        names = {b["node"] for b in best[:k]}
        if width <= tol or (len(best) > k and best[k - 1]["lower"] >= max((x["upper"] for x in rest if x["node"] not in names), default=0.0)):
            break
    return bounded.orderBy(F.desc("lower"), "node").limit(k)
