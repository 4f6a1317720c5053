"""Biconnected components in tables, against a brute force by removed nodes."""

import itertools

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.operators import blocks as K


def wanted(edges):
    """Edges at a node are in one component if their far ends stay connected without it."""
    edges = sorted({(max(e), min(e)) for e in edges if e[0] != e[1]})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    name = {e: e for e in edges}

    def top(e):
        while name[e] != e:
            e = name[e]
        return e

    for v in near:
        reach = {}
        for a in sorted(near[v]):
            if a not in reach:
                todo = [a]
                while todo:
                    x = todo.pop()
                    if x != v and x not in reach:
                        reach[x] = a
                        todo += near[x]
        for a, b in itertools.combinations(sorted(near[v]), 2):
            if reach[a] == reach[b]:
                name[top((max(v, a), min(v, a)))] = top((max(v, b), min(v, b)))
    out = {}
    for e in edges:
        out.setdefault(top(e), set()).add(e)
    return {frozenset(x) for x in out.values()}


def found(spark, edges):
    e = spark.createDataFrame(edges, "src long, dst long")
    parts = {}
    for r in K.block_edges(Graph.from_edges(e, multi="keep")).collect():
        parts.setdefault(r.component, []).append((r.src, r.dst))
    assert all(len(p) == len(set(p)) for p in parts.values())
    assert all(any(c in e for e in p) for c, p in parts.items())
    return {frozenset(p) for p in parts.values()}


def cases():
    rng = np.random.default_rng(4)
    draw = lambda n, m: [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
    cactus = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (4, 7), (7, 8), (8, 9), (9, 4)]
    return {
        "sparse": draw(60, 55),
        "cyclic": draw(60, 80),
        "ring_and_path": [(i, (i + 1) % 40) for i in range(40)] + [(i, i + 1) for i in range(39, 70)],
        "star_loops_parallel": [(0, i) for i in range(1, 20)] + [(3, 3), (5, 0), (0, 5), (7, 8), (30, 30)],
        "cactus_and_clique": cactus + [(a + 20, b + 20) for a, b in itertools.combinations(range(5), 2)] + [(24, 9)],
    }


@pytest.mark.parametrize(("name", "top"), [("sparse", 12), ("cyclic", 2), ("ring_and_path", 2), ("star_loops_parallel", 12), ("cactus_and_clique", 12)])
def test_blocks(spark, monkeypatch, name, top):
    monkeypatch.setattr(K, "TOP", top)
    edges = cases()[name]
    assert found(spark, edges) == wanted(edges)


def test_no_edges_and_arcs(spark):
    v = spark.createDataFrame([(1,), (2,)], "id long")
    none = Graph.from_edges(spark.createDataFrame([(2, 2)], "src long, dst long"), vertices=v)
    assert K.biconnected_components(none).collect() == []
    with pytest.raises(ValueError):
        K.block_edges(Graph(none.vertices, none.edges, True))


def test_bounds_of_ranges(spark, monkeypatch):
    rng = np.random.default_rng(9)
    lo, hi = rng.integers(0, 1000, 300), rng.integers(0, 1000, 300)
    values = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(lo, hi, strict=True))], "at long, lo long, hi long")
    starts = rng.integers(0, 300, 200)
    rows = [(i, int(s), int(rng.integers(1, 301 - s))) for i, s in enumerate(starts)]
    ranges = spark.createDataFrame(rows, "node long, start long, size long")
    for top in (12, 3):
        monkeypatch.setattr(K, "TOP", top)
        got = {r.node: (r.lo, r.hi) for r in K.range_bounds(values, ranges, 300).collect()}
        assert got == {i: (lo[s : s + k].min(), hi[s : s + k].max()) for i, s, k in rows}
