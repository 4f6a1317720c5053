"""Louvain and Leiden, wherever nodes and edges are held."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import community as M


def drawn(spark, seed, n=120, m=700):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, 8, n)
    rows = [(int(a) * 3 - 50, int(b) * 3 - 50, float(rng.integers(1, 4))) for a, b in rng.integers(0, n - 4, (m, 2)) if own[a] == own[b] or rng.random() < 0.15]
    vertices = spark.range(n).select((F.col("id") * 3 - 50).alias("id"))
    return Graph.from_edges(spark.createDataFrame(rows + [(-50, -50, 2.0)], "src long, dst long, weight double"), vertices=vertices, multi="sum")


@pytest.mark.parametrize("f", [lambda g: M.louvain(g), lambda g: M.louvain(g, refine=True), lambda g: M.leiden(g)])
def test_communities_do_not_depend_on_where_edges_lie(spark, monkeypatch, f):
    g = drawn(spark, 5)
    want = {r["node"]: r["community"] for r in f(g).collect()}
    monkeypatch.setattr(M, "LOCAL_EDGES", 20)
    monkeypatch.setattr(M, "BLOCK_ARCS", 100)
    assert {r["node"]: r["community"] for r in f(g).collect()} == want and len(want) == 120


def test_refinement_is_done_beyond_the_driver_too(spark, monkeypatch):
    g = drawn(spark, 6)
    monkeypatch.setattr(M, "STATE_NODES", 30)
    sizes, real = [], M._relational_moves
    monkeypatch.setattr(M, "_relational_moves", lambda g, arcs, state, *more: sizes.append((state.count(), state.select("c").distinct().count())) or real(g, arcs, state, *more))
    assert M.louvain(g, refine=True).select("node").distinct().count() == 120
    assert len(sizes) > 1 and sizes[-1][0] == 120 and sizes[-1][1] < 60
