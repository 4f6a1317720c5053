"""Community detection: Louvain, Leiden, map equation, agglomeration, label propagation in order of degree, and helpers.

Louvain and Leiden keep a row per node on the driver. While a level has more than LOCAL_EDGES edges these lie in a
table, a row of neighbours per node; a round broadcasts the nodes' communities and brings back moves, and the next
level is one aggregation of edges. Below the bound, edges come to the driver too. Moves and results are the same
either way. Only levels of more than STATE_NODES nodes, which the driver can't hold, move in relational rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import modularity as M
from graphloom.kernels.csr import collect, frame
from graphloom.operators.components import star_components
from graphloom.plans.scratch import discard, materialize

#: Edges of a level that the driver takes over.
LOCAL_EDGES = 2_000_000
#: Nodes of which the driver holds a row each.
STATE_NODES = 20_000_000
#: Arcs that one task sorts by node, about.
BLOCK_ARCS = 1_000_000
ROUNDS, LEVELS = 12, 12


def _round(arcs: DataFrame, state: DataFrame, total: float, gamma: float, turn: int, alone_only: bool) -> DataFrame:
    """state (id, k, c, g) after a round in which about half of the nodes may move; g is a group that moves stay within."""
    s = lambda side: state.select(F.col("id").alias(side), F.col("c").alias("c" + side), F.col("g").alias("g" + side))
    near = arcs.join(s("v"), "v")
    near = near.join(state.select(F.col("id").alias("u"), F.col("g").alias("gu")), "u").where("gu = gv") if alone_only else near
    votes = near.groupBy("u", F.col("cv").alias("to")).agg(F.sum("w").alias("aff"))
    vol = state.groupBy("c").agg(F.sum("k").alias("vol"), F.count("*").alias("size"))
    own = state.select(F.col("id").alias("u"), "k", "c").join(vol, "c").withColumnsRenamed({"vol": "own_vol", "size": "own_size"})
    stay = votes.withColumnsRenamed({"to": "c", "aff": "own_aff"})
    offers = votes.join(own, "u").join(stay, ["u", "c"], "left").where("to <> c").join(vol.select(F.col("c").alias("to"), "vol"), "to")
    gain = (F.col("aff") - F.coalesce("own_aff", F.lit(0.0))) / total + gamma * ((F.col("own_vol") - F.col("k")) - F.col("vol")) * F.col("k") / (2 * total * total)
    turn_of = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0
    offers = offers.withColumn("gain", gain).where("gain > 1e-12").where(turn_of("u"))
    if alone_only:  # lone nodes go to communities whose namesake stays
        offers = offers.where("own_size = 1").where(~turn_of("to"))
    best = offers.groupBy("u").agg(F.max(F.struct("gain", (-F.col("to")).alias("m"))).alias("b")).select(F.col("u").alias("id"), (-F.col("b.m")).alias("to"))
    return state.join(best, "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"), "g", F.col("to").isNotNull().alias("moved"))


def _relational_moves(g: Graph, arcs: DataFrame, state: DataFrame, total: float, gamma: float, alone_only: bool) -> DataFrame:
    for turn in range(ROUNDS):
        new = materialize(_round(arcs, state, total, gamma, turn, alone_only), "move")
        count = new.where("moved").count()
        discard(state)
        state = new.select("id", "k", "c", "g")
        state._scratch_path = new._scratch_path
        if not count:
            break
    return state


def _blobs(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _packed(t: pa.Table) -> pa.Table:
    """Arcs (u, v, w) of some nodes as rows (u, v, w) of neighbours and weights as bytes."""
    u = t.column("u").to_numpy()
    order = np.argsort(u, kind="stable")
    u = u[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, dtype=np.int64)
    ends = np.append(first, len(u))
    v, w = t.column("v").to_numpy()[order].astype(np.int32), t.column("w").to_numpy()[order].astype(np.float64)
    return pa.table({"u": pa.array(u[first], pa.int32()), "v": _blobs(v.tobytes(), ends * 4), "w": _blobs(w.tobytes(), ends * 8)})


def _bytes_of(c: pa.Array) -> tuple[np.ndarray, memoryview]:
    _, offsets, data = c.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[c.offset : c.offset + len(c) + 1]
    return np.diff(offsets), memoryview(data or b"")[offsets[0] : offsets[-1]]


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, x): the arcs of packed rows."""
    size, v = _bytes_of(b.column("v"))
    return np.repeat(b.column("u").to_numpy().astype(np.int64), size // 4), np.frombuffer(v, dtype=np.int32), np.frombuffer(_bytes_of(b.column("w"))[1], dtype=np.float64)


class _Table:
    """A level (see kernels.modularity.Level) whose edges (u, v, w) lie in a written table."""

    def __init__(self, edges: DataFrame, n: int):
        self.edges, self.n, self.sc = edges, n, edges.sparkSession.sparkContext
        one = edges.agg(F.count("*").alias("m"), F.sum("w").alias("w"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w"))).alias("loops")).first()
        self.total, self.loops = one["w"] or 0.0, one["loops"] or 0.0
        parts = -(-2 * one["m"] // BLOCK_ARCS)
        arcs = edges.where("u <> v").select(F.explode(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))).alias("x")).select("x.*")
        ends = edges.select(F.explode(F.array("u", "v")).alias("u"), "w").groupBy("u").agg(F.sum("w").alias("k")).toArrow()
        self.k = np.zeros(n)
        self.k[ends.column("u").to_numpy()] = ends.column("k").to_numpy()
        self.near = materialize(arcs.groupBy((F.col("u") % parts).alias("p")).applyInArrow(lambda t: _packed(t), "u int, v binary, w binary"), "near")
        self.sent = self.sc.broadcast(self.k)

    def offers(self, c: np.ndarray, vol: np.ndarray, gamma: float, may: np.ndarray, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, bool, float]:
        total, volumes = self.total, self.sent
        ship = self.sc.broadcast((c.astype(np.int32), vol, may, None if within is None else within.astype(np.int32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, vol, may, within = ship.value
            gains, own = False, 0.0
            for batch in batches:
                node, to, some, inner = M.offers(*_unpacked(batch), c, volumes.value, vol, total, gamma, may, within)
                gains, own = gains or some, own + inner
                yield pa.record_batch({"node": pa.array(node, pa.int32()), "to": pa.array(to, pa.int32()), "own": pa.nulls(len(node), pa.float64())})
            yield pa.record_batch({"node": pa.array([-1], pa.int32()), "to": pa.array([int(gains)], pa.int32()), "own": pa.array([own], pa.float64())})

        t = self.near.mapInArrow(run, "node int, to int, own double").toArrow()
        ship.destroy()
        node, to = t.column("node").to_numpy(), t.column("to").to_numpy()
        sums = node < 0
        return node[~sums], to[~sums], bool(to[sums].any()), float(t.column("own").to_numpy()[sums].sum())

    def contracted(self, c: np.ndarray, n: int) -> M.Level | _Table:
        ship = self.sc.broadcast(c.astype(np.int32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (ship.value[b.column(i).to_numpy()] for i in (0, 1))
                yield pa.record_batch({"u": pa.array(np.maximum(x, y)), "v": pa.array(np.minimum(x, y)), "w": b.column(2)})

        e = materialize(self.edges.mapInArrow(run, "u int, v int, w double").groupBy("u", "v").agg(F.sum("w").alias("w")), "level")
        return _level(e, n)


def _level(edges: DataFrame, n: int) -> M.Level | _Table:
    """Written edges (u, v, w) of nodes 0 to n - 1 as a level; on the driver in order of their ends."""
    if edges.count() > LOCAL_EDGES:
        return _Table(edges, n)
    u, v, w = (c.to_numpy() for c in edges.toArrow().columns)
    order = np.lexsort((v, u))
    return M.Level(u[order].astype(np.int64), v[order].astype(np.int64), w[order], n)


def _numbered(g: Graph) -> tuple[np.ndarray, M.Level | _Table]:
    """Ids that rise, and the graph on their numbers."""
    ids = np.sort(g.vertices.select(F.col("id").cast("long")).toArrow().column(0).to_numpy())
    ship = g.vertices.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (np.searchsorted(ship.value, b.column(i).to_numpy()) for i in (0, 1))
            yield pa.record_batch({"u": pa.array(u, pa.int32()), "v": pa.array(v, pa.int32()), "w": b.column(2)})

    return ids, _level(materialize(g.edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")).mapInArrow(run, "u int, v int, w double"), "level"), len(ids))


def _ends(edges: DataFrame) -> DataFrame:
    """(id, k): volumes, loops counting twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("k"))


def _detect(g: Graph, gamma: float, leiden: bool, refine: bool, seed: int) -> DataFrame:
    if g.directed:
        raise ValueError("communities are sought in undirected graphs")
    g = Graph(g.vertices.select("id"), materialize(g.edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "level"))
    maps: list[DataFrame] = []
    level, start = g, None
    for _ in range(LEVELS):
        if level.vertices.count() <= STATE_NODES:
            break
        arcs = materialize(level.arcs().where("u <> v"), "arcs")
        total = level.edges.agg(F.sum("weight")).first()[0] or 0.0
        if not total:
            break
        first = level.vertices.join(_ends(level.edges), "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k"))
        first = first.join(start, "id") if start is not None else first.withColumn("c", F.col("id"))
        state = _relational_moves(level, arcs, materialize(first.select("id", "k", "c", F.lit(0).cast("long").alias("g")), "move"), total, gamma, False)
        fine = state
        if leiden:
            fine = _relational_moves(level, arcs, materialize(state.select("id", "k", F.col("id").alias("c"), F.col("c").alias("g")), "move"), total, gamma, True)
            start = materialize(fine.select(F.col("c").alias("id"), F.col("g").alias("c")).distinct(), "start")
        to = materialize(fine.select("id", "c"), "map")
        maps.append(to)
        e = level.edges.join(to.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(to.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
        e = e.groupBy(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
        nodes, before = materialize(to.select(F.col("c").alias("id")).distinct(), "level-v"), level.vertices.count()
        level = Graph(nodes, materialize(e, "level"))
        if nodes.count() >= before:
            break
    if level.vertices.count() <= STATE_NODES:
        ids, held = _numbered(level)
        begin = None
        if start is not None:
            known = start.toArrow()
            begin = known.column("c").to_numpy()[np.argsort(known.column("id").to_numpy())]
        c = M.detected(held, gamma, seed, begin, refine and not maps, leiden)
        least = np.full(c.max() + 1 if len(c) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, c, ids)
        last = g.vertices.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "c": pa.array(least[c], pa.int64())}))
        maps.append(materialize(last, "map"))
    if not maps:
        return g.vertices.select(F.col("id").alias("node"), F.col("id").alias("community"))
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("id").alias("c"), F.col("c").alias("d")), "c").select("id", F.col("d").alias("c"))
    if refine and len(maps) > 1:  # the whole graph is not on the driver
        total = g.edges.agg(F.sum("weight")).first()[0]
        first = out.join(_ends(g.edges), "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k"), "c", F.lit(0).cast("long").alias("g"))
        out = _relational_moves(g, materialize(g.arcs().where("u <> v"), "arcs"), materialize(first, "move"), total, gamma, False)
    return materialize(out.select(F.col("id").alias("node"), F.col("c").alias("community")), "communities")


def louvain(g: Graph, gamma: float = 1.0, refine: bool = False, seed: int = 1) -> DataFrame:
    """(node, community): moves by the gain of modularity at resolution gamma, contraction, and again. refine: moves once more on the whole graph."""
    return _detect(g, gamma, False, refine, seed)


def leiden(g: Graph, gamma: float = 1.0, seed: int = 1, iterations: int = 1) -> DataFrame:
    """(node, community), every community connected: contraction follows a refinement inside the moved communities."""
    out = _detect(g, gamma, True, False, seed)
    for i in range(1, iterations):
        out = better_of(g, out, _detect(g, gamma, True, False, seed + i), gamma)
    # a community of several refined parts may lie apart: its components become communities
    return connected_parts(g, out)


def connected_parts(g: Graph, p: DataFrame) -> DataFrame:
    """(node, community): each community cut into its connected parts, named by their least node."""
    s = lambda c, n: p.select(F.col("node").alias(c), F.col("community").alias(n))
    inner = g.edges.join(s("src", "a"), "src").join(s("dst", "b"), "dst").where("a = b").select("src", "dst")
    c = star_components(inner)
    return p.select("node").join(c, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def better_of(g: Graph, p: DataFrame, q: DataFrame, gamma: float = 1.0) -> DataFrame:
    from graphloom.operators.partitions import modularity

    a, b = (modularity(g, x, gamma).first()["modularity"] or 0.0 for x in (p, q))
    return p if a >= b else q


def louvain_map_equation(g: Graph, hierarchical: bool = True) -> DataFrame:
    """(node, community) that shorten the two-level map equation; without hierarchical, by moves of single nodes only."""
    from graphloom.operators.codelength import shortened

    return shortened(g, hierarchical)


def _named(g: Graph, csr, c: np.ndarray) -> DataFrame:
    least = np.full(int(c.max()) + 1 if len(c) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, c, csr.ids)
    return frame(g, list(zip(csr.ids.tolist(), least[c].tolist(), strict=True)), "node long, community long")


def map_equation(g: Graph, p: DataFrame) -> DataFrame:
    """One row: bits of the two-level map equation of p."""
    s = lambda c, n: p.select(F.col("node").alias(c), F.col("community").alias(n))
    e = g.edges.join(s("src", "a"), "src").join(s("dst", "b"), "dst")
    total = 2 * (e.agg(F.sum("weight")).first()[0] or 0.0)
    plogp = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("n"), F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("dst").alias("n"), F.col("b").alias("c"), F.col("a").alias("o")))).alias("x"), "weight").select("x.*", "weight")
    per = ends.groupBy("c").agg((F.sum("weight") / total).alias("vol"), (F.sum(F.when(F.col("c") != F.col("o"), F.col("weight")).otherwise(0.0)) / total).alias("q"))
    nodes = ends.groupBy("n").agg((F.sum("weight") / total).alias("p")).agg(F.sum(plogp(F.col("p"))).alias("np"))
    one = F.lit(1).alias("_k")
    s2 = per.agg(F.sum("q").alias("q"), F.sum(plogp(F.col("q"))).alias("qq"), F.sum(plogp(F.col("q") + F.col("vol"))).alias("qv"))
    return s2.select("*", one).join(nodes.select("*", one), "_k").select((plogp(F.col("q")) - 2 * F.col("qq") - F.col("np") + F.col("qv")).alias("bits"))


def modularity_scores(g: Graph) -> DataFrame:
    """(src, dst, score): what contracting each edge's ends, as communities, adds to modularity."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("vol"))
    total = g.edges.agg(F.sum("weight")).first()[0] or 0.0
    v = lambda c, n: ends.select(F.col("id").alias(c), F.col("vol").alias(n))
    e = g.edges.where("src <> dst").join(v("src", "a"), "src").join(v("dst", "b"), "dst")
    return e.select("src", "dst", (F.col("weight") / total - F.col("a") * F.col("b") / (2 * total * total)).alias("score"))


def agglomerative(g: Graph, levels: int = 30) -> DataFrame:
    """(node, community): edges scored by the gain of modularity are matched greedily, matched pairs contracted, and again while any gain is left."""
    from graphloom.operators.iterative import greedy_matching

    level = Graph(g.vertices.select("id"), materialize(g.edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "level"))
    out = g.vertices.select(F.col("id").alias("node"), F.col("id").alias("community"))
    for _ in range(levels):
        good = materialize(modularity_scores(level).where("score > 1e-12").withColumnRenamed("score", "weight"), "gains")
        if good.isEmpty():
            break
        pairs = greedy_matching(Graph(level.vertices, good))
        to = materialize(pairs.select(F.col("src").alias("id"), F.col("dst").alias("c")), "pairs")  # dst is the lesser
        t = lambda c, n, to=to: to.select(F.col("id").alias(c), F.col("c").alias(n))
        e = level.edges.join(t("src", "a"), "src", "left").join(t("dst", "b"), "dst", "left").select(F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b"), "weight")
        e = e.groupBy(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
        level = Graph(level.vertices.join(to.select("id"), "id", "left_anti"), materialize(e, "level"))
        out = materialize(out.join(t("community", "to"), "community", "left").select("node", F.coalesce("to", "community").alias("community")), "agglomerated")
    return out


def label_propagation_by_degree(g: Graph, rounds: int = 100) -> DataFrame:
    """(node, community): nodes take the most frequent label around them one after another, by rising degree, until at most one in 100000 changes. On the driver."""
    c = collect(g)
    label, order = np.arange(c.n), np.lexsort((np.arange(c.n), c.degree()))
    for _ in range(rounds):
        changes = 0
        for u in order.tolist():
            near = label[c.out(u)]
            if len(near):
                names, k = np.unique(near, return_counts=True)
                top = names[k == k.max()]
                if label[u] not in top:
                    label[u], changes = top[0], changes + 1
        if changes <= c.n / 1e5:
            break
    return _named(g, c, np.unique(label, return_inverse=True)[1])


def k_core_communities(g: Graph, k: int) -> DataFrame:
    """(node, community): components of the k-core; nodes outside are communities of their own."""
    from graphloom.operators.iterative import core_numbers

    e = materialize(g.edges.where("src <> dst").select("src", "dst").distinct(), "k-core")
    without = lambda ids, how: e.join(ids.withColumnRenamed("id", "src"), "src", how).join(ids.withColumnRenamed("id", "dst"), "dst", how).select("src", "dst")
    if g.directed:
        e = without(core_numbers(g).where(F.col("core") >= k).select(F.col("node").alias("id")), "left_semi")
    while not g.directed:  # nodes of fewer than k neighbours leave, until none does
        d = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
        out = materialize(d.where(F.col("count") < k).select("id"), "k-out")
        if out.isEmpty():
            break
        new = materialize(without(out, "left_anti"), "k-core")
        discard(e, out)
        e = new
    c = star_components(e)
    return g.vertices.withColumnRenamed("id", "node").join(c, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def cut_clustering(g: Graph, alpha: float) -> DataFrame:
    """(node, community): minimum cuts between each node and a sink linked to all with weight alpha. On the driver."""
    from graphloom.kernels.flow import max_flow

    c = collect(g)
    label = np.full(c.n, -1)
    order = np.argsort(-c.strength(), kind="stable")
    src, dst, w = np.concatenate([c.src, np.arange(c.n)]), np.concatenate([c.dst, np.full(c.n, c.n)]), np.concatenate([c.weight, np.full(c.n, alpha)])
    for u in order.tolist():
        if label[u] < 0:
            _, _, side = max_flow(c.n + 1, src, dst, w, u, c.n)
            own = [x for x in side if x < c.n]
            for old in {int(label[x]) for x in own} - {-1}:  # cut sides are nested or disjoint
                label[label == old] = u
            label[own] = u
    return _named(g, c, np.unique(label, return_inverse=True)[1])


def spectral_partition(g: Graph, parts: int = 2) -> DataFrame:
    """(node, community): halves by the second eigenvector of the Laplacian, the largest part halved again until there are enough. On the driver, at most SPECTRAL nodes."""
    from graphloom.kernels.spectral import laplacian

    lap, c = laplacian(g)
    groups = [np.arange(c.n)]
    while len(groups) < parts and max(map(len, groups)) > 1:
        groups.sort(key=len)
        big = groups.pop()
        sub = lap[np.ix_(big, big)]
        sub = sub - np.diag(sub.sum(axis=1))  # the Laplacian of the part alone
        vec = np.linalg.eigh(sub)[1][:, 1]
        half = np.argsort(vec, kind="stable")
        groups += [big[half[: len(big) // 2]], big[half[len(big) // 2 :]]]
    label = np.zeros(c.n, dtype=np.int64)
    for i, x in enumerate(groups):
        label[x] = i
    return _named(g, c, label)


def hashed_overlap(partitions: list[DataFrame]) -> DataFrame:
    """(node, community): nodes that all partitions put together share a community, named by its least node."""
    both = partitions[0].select("node", F.array("community").alias("t"))
    for p in partitions[1:]:
        both = both.join(p, "node").select("node", F.array_append("t", F.col("community")).alias("t"))
    names = both.groupBy("t").agg(F.min("node").alias("community"))
    return both.join(names, "t").select("node", "community")
