"""Randomization that keeps degrees, and walks, embeddings and epidemics on a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels.csr import collect, frame
from graphloom.plans.scratch import discard, materialize
from graphloom.plans.spread import ROWS, spread

#: Edges and nodes of a graph that is switched or traded step by step on the driver; larger ones are in tables.
LOCAL_EDGES = 200_000


def _in_pairs(df: DataFrame, rows: int, seed: int, turn: int) -> DataFrame:
    """(pair, each column of df with 0 and with 1 behind its name): about so many different rows in random pairs, dealt out and sorted by a hash; the last one of a task may stay alone, with nulls beside it."""
    parts = max(-(-rows // ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_h", F.xxhash64(*df.columns, F.lit(seed), F.lit(turn))).repartition(parts, "_h").sortWithinPartitions("_h", *df.columns)
    names = ["pair"] + [f"{c}{i}" for i in (0, 1) for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest = TaskContext.get().partitionId() << 33, None
        for b in batches:
            t = pa.Table.from_batches([b]).drop_columns(["_h"])
            t = t if rest is None else pa.concat_tables([rest, t])
            even = t.num_rows // 2 * 2
            one, two = (t.take(pa.array(np.arange(i, even, 2))) for i in (0, 1))
            rest = t.slice(even)
            yield from pa.Table.from_arrays([pa.array(np.arange(at, at + even // 2)), *one.columns, *two.columns], names=names).to_batches()
            at += even // 2
        if rest is not None and rest.num_rows:
            yield from pa.Table.from_arrays([pa.array([at]), *rest.columns, *(pa.nulls(1, c.type) for c in rest.columns)], names=names).to_batches()

    return dealt.mapInArrow(run, "pair long, " + ", ".join(f"{c}{i} {t}" for i in (0, 1) for c, t in df.dtypes))


def degree_preserving_shuffle(g: Graph, seed: int = 1) -> Graph:
    """Ids permuted at random among nodes of equal degree (in and out)."""
    from graphloom.operators.structure import degrees, in_degrees

    d = degrees(g).join(in_degrees(g).select("node", F.col("degree").alias("in")), "node").select("node", "degree", "in")
    d = materialize(d, "degrees")
    w = Window.partitionBy("degree", "in")
    a = d.select("node", "degree", "in", F.row_number().over(w.orderBy("node")).alias("r"))
    b = d.select(F.col("node").alias("to"), "degree", "in", F.row_number().over(w.orderBy(F.xxhash64("node", F.lit(seed)), "node")).alias("r"))
    ids = materialize(a.join(b, ["degree", "in", "r"]).select(F.col("node").alias("id"), F.col("to").alias("number")), "shuffle")
    from graphloom.operators.toolbox import remapped

    return remapped(g, ids)


def edge_switching(g: Graph, per_edge: float = 10.0, seed: int = 1) -> Graph:
    """Pairs of random edges swap ends where no loop or second edge comes of it: per_edge tries an edge, one after another on the driver up to LOCAL_EDGES, all edges at once in tables beyond."""
    g = g.materialized()
    if (m := max(g.edges.count(), g.vertices.count())) > LOCAL_EDGES:
        return _switched_in_tables(g, m, per_edge, seed)
    c = collect(g)
    rng, src, dst = np.random.default_rng(seed), c.src.copy(), c.dst.copy()
    key = (lambda a, b: (a, b)) if g.directed else (lambda a, b: (max(a, b), min(a, b)))
    have = {key(a, b) for a, b in zip(src.tolist(), dst.tolist(), strict=True)}
    tries = int(per_edge * c.m / 2)
    picks, flips = rng.integers(0, max(c.m, 1), (tries, 2)), rng.random(tries) < 0.5
    for (i, j), flip in zip(picks.tolist(), flips.tolist(), strict=True):
        a, b, x, y = int(src[i]), int(dst[i]), int(src[j]), int(dst[j])
        if flip and not g.directed:
            x, y = y, x
        one, two = key(a, y), key(x, b)
        if i == j or a == y or x == b or one == two or one in have or two in have:
            continue
        have -= {key(a, b), key(x, y)}
        have |= {one, two}
        src[i], dst[i], src[j], dst[j] = a, y, x, b
    rows = [(c.ids[a] if g.directed else max(c.ids[a], c.ids[b]), c.ids[b] if g.directed else min(c.ids[a], c.ids[b]), float(w)) for a, b, w in zip(src.tolist(), dst.tolist(), c.weight.tolist(), strict=True)]
    return Graph(g.vertices, frame(g, rows, "src long, dst long, weight double"), g.directed)


def _switched_in_tables(g: Graph, m: int, per_edge: float, seed: int) -> Graph:
    """A round pairs all edges. A pair swaps ends if neither new edge is there yet, and each is its own: of pairs that want the same edge, the first has it."""
    e, turn = g.edges.select("src", "dst", "weight"), 0
    while turn < per_edge:
        draw = lambda k, t=turn: F.pmod(F.xxhash64("pair", F.lit(seed), F.lit(t), F.lit(k)), F.lit(1 << 30))
        p = _in_pairs(e, m, seed, turn)
        flip = F.lit(False) if g.directed else draw(0) < 1 << 29
        x, y = F.when(flip, F.col("dst1")).otherwise(F.col("src1")), F.when(flip, F.col("src1")).otherwise(F.col("dst1"))
        key = (lambda a, b: F.struct(a.alias("s"), b.alias("d"))) if g.directed else (lambda a, b: F.struct(F.greatest(a, b).alias("s"), F.least(a, b).alias("d")))
        one, two = key(F.col("src0"), y), key(x, F.col("dst0"))
        can = F.col("src1").isNotNull() & (F.col("src0") != y) & (x != F.col("dst0")) & (one != two) & (draw(1) < int(min(per_edge - turn, 1.0) * (1 << 30)))
        p = materialize(p.select("*", F.when(can, one).alias("one"), F.when(can, two).alias("two")), "switch")
        old = lambda i: F.struct(F.col(f"src{i}").alias("s"), F.col(f"dst{i}").alias("d"))
        wants = lambda k, pair: F.struct(k.alias("k"), pair.alias("pair"))
        none = F.lit(None).cast("long")
        keys = p.select(F.explode(F.array(wants(old(0), none), wants(old(1), none), wants(F.col("one"), F.col("pair")), wants(F.col("two"), F.col("pair")))).alias("x"))
        keys = spread(keys.select("x.k.s", "x.k.d", "x.pair").where("s IS NOT NULL"), 2 * m, "s", "d")
        first = keys.groupBy("s", "d").agg(F.count_if(F.col("pair").isNull()).alias("there"), F.min("pair").alias("pair")).where("there = 0")
        done = first.groupBy("pair").agg(F.count("*").alias("k")).where("k = 2")
        r = p.join(done, "pair", "left")
        took = lambda n, i: F.struct(*(F.when(F.col("k") == 2, F.col(f"{n}.{c[0]}")).otherwise(F.col(f"{c}{i}")).alias(c) for c in ("src", "dst")), F.col(f"weight{i}").alias("weight"))
        new = materialize(r.select(F.explode(F.array(took("one", 0), took("two", 1))).alias("x")).select("x.*").where("src IS NOT NULL"), "switched")
        discard(p, e if turn else None)
        e, turn = new, turn + 1
    return Graph(g.vertices, e, g.directed)


def uniform_trades(k: int, n: int, seed: int = 1) -> list[tuple[int, int]]:
    """k random pairs of different nodes."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, n, k)
    return list(zip(a.tolist(), ((a + rng.integers(1, n, k)) % n).tolist(), strict=True))


def global_trades(rounds: int, n: int, seed: int = 1) -> list[tuple[int, int]]:
    """In each round all nodes (but one, if odd) in random pairs."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(rounds):
        p = rng.permutation(n)[: n - n % 2]
        out += list(zip(p[::2].tolist(), p[1::2].tolist(), strict=True))
    return out


def curveball(g: Graph, trades: list[tuple[int, int]], seed: int = 1) -> Graph:
    """Undirected simple graphs: the nodes of each pair, given by ids, deal out anew the neighbours that only one of them has; on the driver."""
    c = collect(g)
    rng = np.random.default_rng(seed)
    near = [set(c.out(u).tolist()) - {u} for u in range(c.n)]
    for a, b in trades:
        u, v = c.index([a, b])
        one, two = near[u] - near[v] - {v}, near[v] - near[u] - {u}
        pool = rng.permutation(sorted(one | two)).tolist()
        first, second = set(pool[: len(one)]), set(pool[len(one) :])
        for x in one - first:
            near[x].discard(u)
            near[x].add(v)
        for x in two - second:
            near[x].discard(v)
            near[x].add(u)
        near[u] = (near[u] - one) | first
        near[v] = (near[v] - two) | second
    rows = [(c.ids[max(u, v)], c.ids[min(u, v)], 1.0) for u in range(c.n) for v in near[u] if v < u]
    return Graph(g.vertices, frame(g, rows, "src long, dst long, weight double"))


def _traded_in_tables(g: Graph, m: int, rounds: int, seed: int) -> Graph:
    """A round draws two halves of the nodes. First the one and then the other half trades, in random pairs, what neighbours it has in the half that rests, so that no two trades meet in an edge and all are done at once."""
    nodes = materialize(g.vertices.select("id").distinct(), "nodes")
    e = materialize(g.edges.where("src <> dst").select("src", "dst").distinct(), "traded")
    for turn in range(2 * rounds):
        trades = lambda c, t=turn: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(t // 2)), F.lit(2)) == t % 2
        pairs = _in_pairs(nodes.where(trades("id")), m, seed, turn)
        pairs = materialize(pairs.select(F.explode(F.array_compact(F.array("id0", "id1"))).alias("u"), "pair", "id0", "id1"), "trades")
        first = trades("src")
        mine = e.where(first != trades("dst")).select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("x"))
        parts = max(-(-m // ROWS), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        t = mine.join(pairs, "u").repartition(parts, "pair").withColumn("has", F.count("*").over(Window.partitionBy("pair", "x")))
        w = Window.partitionBy("pair")
        draw = F.row_number().over(w.orderBy("has", F.xxhash64("x", "pair", F.lit(seed), F.lit(turn)), "x"))
        t = t.withColumns({"room": F.count_if((F.col("has") == 1) & (F.col("u") == F.col("id0"))).over(w), "r": draw})
        u = F.when(F.col("has") == 2, F.col("u")).when(F.col("r") <= F.col("room"), F.col("id0")).otherwise(F.col("id1"))
        t = t.select(u.alias("u"), "x").select(F.greatest("u", "x").alias("src"), F.least("u", "x").alias("dst"))
        new = materialize(e.where(first == trades("dst")).union(t), "traded")
        discard(e, pairs)
        e = new
    return Graph(g.vertices, e.select("src", "dst", F.lit(1.0).alias("weight")))


def global_curveball(g: Graph, rounds: int = 20, seed: int = 1, shuffle: bool = True) -> Graph:
    """Rounds of trades of all nodes in random pairs, after a shuffle of equal degrees; one after another on the driver up to LOCAL_EDGES edges, in tables beyond."""
    h = (degree_preserving_shuffle(g, seed) if shuffle else g).materialized()
    if (m := max(h.edges.count(), h.vertices.count())) > LOCAL_EDGES:
        return _traded_in_tables(h, m, rounds, seed)
    ids = [r["id"] for r in h.vertices.select("id").orderBy("id").collect()]
    return curveball(h, [(ids[a], ids[b]) for a, b in global_trades(rounds, len(ids), seed)], seed) if len(ids) > 1 else h


# walks and embeddings


def biased_walks(g: Graph, p: float = 1.0, q: float = 1.0, length: int = 80, walks: int = 10, seed: int = 1) -> DataFrame:
    """(walk array<string>): walks from every node, steps back weighing 1 / p, to neighbours of the last node 1, farther 1 / q; nodes are dealt out."""
    from graphloom.kernels.csr import Csr, per_source

    def run(c: Csr, u: int) -> list[tuple]:
        out = []
        for i in range(walks):
            rng, at = np.random.default_rng([seed, int(c.ids[u]) & 0x7FFFFFFF, i]), [u]
            while len(at) < length:
                near, w = c.out(at[-1]), c.weights(at[-1])
                if not len(near):
                    break
                if len(at) > 1:
                    last = c.out(at[-2])
                    close = np.isin(near, last)
                    w = w * np.where(near == at[-2], 1 / p, np.where(close, 1.0, 1 / q))
                s = np.cumsum(w)
                at.append(int(near[min(int(np.searchsorted(s, rng.random() * s[-1], "right")), len(near) - 1)]))
            out.append(([str(int(c.ids[x])) for x in at],))
        return out

    return per_source(g, None, run, "walk array<string>")


def node2vec(g: Graph, p: float = 1.0, q: float = 1.0, length: int = 80, walks: int = 10, dim: int = 128, window: int = 10, iterations: int = 1, seed: int = 1) -> DataFrame:
    """(node, features array<double>): skip-gram vectors of biased walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = materialize(biased_walks(g, p, q, length, walks, seed), "walks")
    parts = max(int(g.vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    model = Word2Vec(vectorSize=dim, minCount=0, numPartitions=parts, maxIter=iterations, seed=seed, windowSize=window, inputCol="walk", outputCol="features", maxSentenceLength=length).fit(rows)
    return model.getVectors().select(F.col("word").cast("long").alias("node"), vector_to_array("vector").alias("features"))


# epidemics


def seir(g: Graph, steps: int, transmission: float, exposed: int, infectious: int, zero: int, seed: int = 1) -> DataFrame:
    """(step, state, nodes): S, E after a contact that passes it on, I after exposed steps, R after infectious more; contacts are drawn by hashes."""
    g = g.materialized()
    arcs = materialize(spread(g.arcs().where("u <> v").select("u", "v"), 2 * g.edges.count(), "u", "v").distinct(), "arcs")
    state = materialize(g.vertices.select("id", F.when(F.col("id") == zero, "E").otherwise("S").alias("s"), F.lit(0).alias("since")), "seir")
    out = None
    for t in range(steps):
        counts = state.groupBy("s").agg(F.count("*").alias("nodes")).select(F.lit(t).alias("step"), F.col("s").alias("state"), "nodes")
        out = materialize(counts if out is None else out.union(counts), "seir-counts")
        contact = F.pmod(F.xxhash64("u", "v", F.lit(t), F.lit(seed)), F.lit(1 << 40)) < F.lit(int(transmission * (1 << 40)))
        hit = arcs.join(state.where("s = 'I'").select(F.col("id").alias("u")), "u").where(contact).select(F.col("v").alias("id")).distinct().withColumn("hit", F.lit(True))
        age = F.lit(t + 1) - F.col("since")
        nxt = F.when((F.col("s") == "S") & F.col("hit"), "E").when((F.col("s") == "E") & (age >= exposed), "I").when((F.col("s") == "I") & (age >= infectious), "R").otherwise(F.col("s"))
        new = state.join(hit, "id", "left").withColumn("n", nxt)
        new = materialize(new.select("id", F.col("n").alias("s"), F.when(F.col("n") != F.col("s"), F.lit(t + 1)).otherwise(F.col("since")).alias("since")), "seir")
        discard(state)
        state = new
    return out
