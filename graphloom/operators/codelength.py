"""Communities that shorten the map equation, in tables.

A level's nodes have a flow p and an exit flow x. A round takes one join along the arcs, which yields each node's flow
to each community beside it, and from these the flow and exit flow of every community, the bits of the present state,
and what each move would add to them. Communities give or take nodes in a round, by a hash, so that no two swap
members. A round that has lengthened the description is undone, and followed by one in which a community takes part
in one move at most, the best on both sides. What the moves leave is contracted; small levels end on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import modularity as K
from graphloom.kernels.csr import collect, frame
from graphloom.plans.scratch import discard, materialize

#: Edges and nodes of a level that the driver takes over: its moves are made one by one.
LOCAL_EDGES = 200_000
ROUNDS, LEVELS = 32, 12
#: Bits that a move or a round must save.
LEAST = 1e-12
#: A level ends after two rounds in a row that each saved less than this share of all it has saved.
SETTLED = 2e-3


def plogp(x: Column) -> Column:
    return F.when(x > 1e-15, x * F.log2(x)).otherwise(0.0)


def _flows(g: Graph) -> tuple[DataFrame, DataFrame] | None:
    """Nodes (id, p, x, c), each its own community, and arcs (u, v, y); None without weight."""
    total = g.edges.agg(F.sum("weight")).first()[0]
    if not total:
        return None
    arcs = materialize(g.arcs().where("u <> v").groupBy("u", "v").agg((F.sum("w") / (2.0 * total)).alias("y")), "flow")
    out = arcs.groupBy(F.col("u").alias("id")).agg(F.sum("y").alias("x"))
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg((F.sum("weight") / (2.0 * total)).alias("p"))
    nodes = g.vertices.select("id").join(ends, "id", "left").join(out, "id", "left")
    return nodes.select("id", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("x", F.lit(0.0)).alias("x"), F.col("id").alias("c")), arcs


def _half(c: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 0


def _moves(g: Graph) -> DataFrame | None:
    """(id, c) after rounds of moves on one level, a table of its own; None without weight."""
    flows = _flows(g)
    if flows is None:
        return None
    state, arcs = materialize(flows[0], "moves"), flows[1]
    kept, bits, bold, first, slow = None, float("inf"), True, None, 0
    for turn in range(ROUNDS):
        near = arcs.join(state.select(F.col("id").alias("v"), F.col("c").alias("to")), "v")
        votes = materialize(near.groupBy("u", "to").agg(F.sum("y").alias("aff")), "votes")
        own = state.select(F.col("id").alias("u"), "p", "x", "c").join(votes.select("u", F.col("to").alias("c"), F.col("aff").alias("inner")), ["u", "c"], "left").fillna(0.0, ["inner"])
        modules = materialize(own.groupBy("c").agg(F.sum("p").alias("vol"), F.greatest(F.sum(F.col("x") - F.col("inner")), F.lit(0.0)).alias("q")), "modules")
        now = modules.agg(F.sum("q").alias("s"), F.sum(plogp(F.col("q"))).alias("a"), F.sum(plogp(F.col("q") + F.col("vol"))).alias("b")).select("s", (plogp(F.col("s")) - 2 * F.col("a") + F.col("b")).alias("bits")).first()
        if kept is not None and now["bits"] > bits - LEAST:
            discard(state, votes, modules)
            state, kept = kept, None
            if not bold:
                break
            bold = False
            continue
        if kept is not None:
            bold = True
            slow = slow + 1 if bits - now["bits"] < SETTLED * (first - now["bits"]) else 0
        discard(kept)
        bits, kept = now["bits"], None
        first = bits if first is None else first
        if slow == 2:
            discard(votes, modules)
            break
        offers = _offers(votes, own, modules, now["s"])
        picked = materialize(offers, "offers")
        left = not picked.isEmpty()
        if left:
            state, kept = materialize(_moved(state, picked, turn, bold), "moves"), state
        discard(votes, modules, picked)
        if not left:
            break
    if kept is not None:  # the last round was not weighed
        discard(state)
        state = kept
    discard(arcs)
    return state.select("id", "c")


def _offers(votes: DataFrame, own: DataFrame, modules: DataFrame, s: float) -> DataFrame:
    """(u, c, to, delta): all moves to a community beside a node that save bits, if they alone are made."""
    old = modules.select("c", F.col("vol").alias("vo"), F.col("q").alias("qo"))
    new = modules.select(F.col("c").alias("to"), F.col("vol").alias("vd"), F.col("q").alias("qd"))
    rows = votes.join(own, "u").where("to <> c").join(old, "c").join(new, "to")
    c = F.col
    rows = rows.withColumns({"ro": F.greatest(c("qo") - c("x") + 2 * c("inner"), F.lit(0.0)), "rd": F.greatest(c("qd") + c("x") - 2 * c("aff"), F.lit(0.0))})
    whole = F.lit(s) - c("qo") - c("qd") + c("ro") + c("rd")
    exits = plogp(c("ro")) + plogp(c("rd")) - plogp(c("qo")) - plogp(c("qd"))
    inner = plogp(c("ro") + c("vo") - c("p")) + plogp(c("rd") + c("vd") + c("p")) - plogp(c("qo") + c("vo")) - plogp(c("qd") + c("vd"))
    return rows.select("u", "c", "to", (plogp(whole) - plogp(F.lit(s)) - 2 * exits + inner).alias("delta")).where(c("delta") < -LEAST)


def _moved(state: DataFrame, offers: DataFrame, turn: int, bold: bool) -> DataFrame:
    """state after each giving community's nodes took their best offer of a taking one, or, if not bold, after moves that are the best of both communities."""
    if bold:
        key = F.struct("delta", "to")
        go = offers.where(_half("c", turn) & ~_half("to", turn)).groupBy("u").agg(F.min(key).alias("m")).select("u", "m.to")
    else:
        key = F.struct("delta", "u", "to")
        sides = offers.select(F.explode(F.array("c", "to")).alias("c"), key.alias("k")).groupBy("c").agg(F.min("k").alias("k"))
        side = lambda c, k: sides.select(F.col("c").alias(c), F.col("k").alias(k))
        go = offers.withColumn("k", key).join(side("c", "k1"), "c").join(side("to", "k2"), "to").where("k = k1 AND k = k2").select("u", "to")
    return state.join(go.withColumnRenamed("u", "id"), "id", "left").select("id", "p", "x", F.coalesce("to", "c").alias("c"))


def shortened(g: Graph, hierarchical: bool = True, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, community), named by a node: rounds of moves, and if hierarchical, contractions and moves of what they left.

    Levels of at most `local` edges and nodes are finished by single moves on the driver. Nodes without edges, and all
    nodes of a graph without weight, stay alone. Undirected graphs only; weights are not negative.
    """
    if g.directed:
        raise ValueError("communities are sought in undirected graphs")
    level = Graph(g.vertices.select("id"), materialize(g.edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "level"))
    out: DataFrame | None = None
    for _ in range(LEVELS):
        m, n = level.edges.count(), level.vertices.count()
        small = m <= local and n <= local
        to = _on_driver(level, local, hierarchical) if small else _moves(level)
        if to is None:
            break
        step = to.select(F.col("id").alias("c"), F.col("c").alias("d"))
        composed = to if out is None else out.join(step, "c").select("id", F.col("d").alias("c"))
        out = materialize(composed, "communities")
        if small or not hierarchical:
            break
        e = level.edges.join(to.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(to.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
        e = e.groupBy(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
        level = Graph(materialize(to.select(F.col("c").alias("id")).distinct(), "level-v"), materialize(e, "level"))
        if level.vertices.count() == n:
            break
    if out is None:
        out = g.vertices.select("id", F.col("id").alias("c"))
    return out.select(F.col("id").alias("node"), F.col("c").alias("community"))


def _on_driver(level: Graph, local: int, hierarchical: bool) -> DataFrame:
    csr = collect(level, max(local, 1))
    c = K.louvain_map(csr.src, csr.dst, csr.weight, csr.n, levels=K.LEVELS if hierarchical else 1)
    least = np.full(int(c.max()) + 1 if len(c) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, c, csr.ids)
    return frame(level, list(zip(csr.ids.tolist(), least[c].tolist(), strict=True)), "id long, c long")
