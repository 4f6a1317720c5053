"""Moves that shorten the map equation, in tables, against single moves on arrays."""

import itertools

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.kernels import modularity as K
from graphloom.operators import codelength as L
from graphloom.operators import community as M


def graph_of(spark, edges, n):
    rows = [(int(a), int(b), float(w)) for a, b, w in edges]
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight double"), vertices=v, multi="sum").materialized()


def bits(edges, c):
    u, v, w = (np.array(x) for x in zip(*edges, strict=True))
    return K.map_equation(u, v, w.astype(float), np.unique(c, return_inverse=True)[1])


def labels(p, n):
    got = {r.node: r.community for r in p.collect()}
    assert len(got) == n
    return np.array([got[i] for i in range(n)])


def clique(first, last):
    return [(a, b, 1) for a, b in itertools.combinations(range(first, last + 1), 2)]


def test_two_cliques(spark):
    edges = clique(0, 4) + clique(5, 9) + [(0, 9, 1), (1, 8, 1), (2, 7, 1)]
    for hierarchical in (False, True):
        c = labels(L.shortened(graph_of(spark, edges, 10), hierarchical, local=0), 10)
        assert len(set(c[:5])) == len(set(c[5:])) == 1 and c[0] != c[5]


def test_planted_groups_and_lone_nodes(spark):
    rng = np.random.default_rng(11)
    edges = [(a, b, 1 + (a + b) % 3) for a, b in itertools.combinations(range(90), 2) if rng.random() < (0.5 if a // 15 == b // 15 else 0.02)] + [(4, 4, 2)]
    g = graph_of(spark, edges, 93)
    c = labels(L.shortened(g, local=0), 93)
    alone = K.louvain_map(*(np.array(x) for x in zip(*[(a, b, float(w)) for a, b, w in edges], strict=True)), 93)
    assert bits(edges, c) <= bits(edges, alone) + 1e-9
    assert M.map_equation(g, M.louvain_map_equation(g)).first()[0] == pytest.approx(bits(edges, alone))
    assert [c[i] for i in (90, 91, 92)] == [90, 91, 92]


def test_nothing_to_shorten(spark):
    v = spark.createDataFrame([(1,), (2,)], "id long")
    none = Graph.from_edges(spark.createDataFrame([], "src long, dst long"), vertices=v)
    assert {tuple(r) for r in L.shortened(none, local=0).collect()} == {(1, 1), (2, 2)}
    weightless = Graph.from_edges(spark.createDataFrame([(2, 1, 0.0)], "src long, dst long, weight double"), vertices=v)
    assert {tuple(r) for r in L.shortened(weightless, local=0).collect()} == {(1, 1), (2, 2)}
    with pytest.raises(ValueError):
        L.shortened(Graph(v, none.edges, True))
