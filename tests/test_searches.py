"""Searches of single sources as arrays: counts and shares against plain searches, also where edges are parallel, loops, or in one direction."""

from __future__ import annotations

import time
from collections import deque

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.kernels.csr import Csr
from graphloom.operators import centralities as C


def arrays(seed, n, m, directed):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(0, n - 3, (2, m))
    return Csr(np.arange(n) * 2 + 5, u * 2 + 5, v * 2 + 5, np.ones(m), directed)


def plain(c, s):
    dist, count, queue, order = {s: 0}, {s: 1}, deque([s]), []
    preds = {s: []}
    while queue:
        u = queue.popleft()
        order.append(u)
        for v, e in zip(c.out(u).tolist(), c.edges_of(u).tolist(), strict=True):
            if v not in dist:
                dist[v], count[v], preds[v] = dist[u] + 1, 0, []
                queue.append(v)
            if dist[v] == dist[u] + 1:
                count[v] += count[u]
                preds[v].append((u, e))
    return dist, count, preds, order


@pytest.mark.parametrize("directed", [False, True])
def test_levels_count_shortest_paths(directed):
    c = arrays(1, 60, 150, directed)
    for s in range(c.n):
        dist, count, _ = C._levels(c, s)
        want, paths, _, _ = plain(c, s)
        assert {i: d for i, d in enumerate(dist.tolist()) if d >= 0} == want and {i: x for i, x in enumerate(count.tolist()) if x} == paths


def test_edge_betweenness_counts_parallel_edges(spark):
    c = arrays(2, 30, 70, False)
    rows = list(zip(c.ids[c.src].tolist(), c.ids[c.dst].tolist(), c.weight.tolist(), strict=True))
    g = Graph(spark.createDataFrame([(int(i),) for i in c.ids], "id long"), spark.createDataFrame(rows, "src long, dst long, weight double"))
    c, want = C.collect(g), {}
    for s in range(c.n):
        _, count, preds, order = plain(c, s)
        own = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u, e in preds[v]:
                x = count[u] / count[v] * (1 + own[v])
                own[u] += x
                want[e] = want.get(e, 0.0) + x
    got = sorted((r.src, r.dst, round(r.score, 9)) for r in C.edge_betweenness(g).collect())
    assert got == sorted((int(c.ids[c.src[e]]), int(c.ids[c.dst[e]]), round(want.get(e, 0.0), 9)) for e in range(c.m))


@pytest.mark.parametrize("directed", [False, True])
def test_sampled_paths_are_shortest(spark, directed):
    c = arrays(3, 40, 90, directed)
    rows = list(zip(c.ids[c.src].tolist(), c.ids[c.dst].tolist(), c.weight.tolist(), strict=True))
    g = Graph(spark.createDataFrame([(int(i),) for i in c.ids], "id long"), spark.createDataFrame(rows, "src long, dst long, weight double"), directed)
    paths: dict[int, set] = {}
    for r in C._sampled_paths(g, 80, 4).collect():
        paths.setdefault(r.sample, set()).add(r.node)
    c = C.collect(g)
    for i in range(80):
        s, t = np.random.default_rng([4, i]).choice(c.n, 2, replace=False).tolist()
        dist = plain(c, s)[0]
        inner = {(x - 5) // 2 for x in paths.get(i, ())}
        assert sorted(dist[x] for x in inner) == list(range(1, dist.get(t, 1)))


def test_searches_take_no_loop_over_arcs():
    n = 1200
    u, v = np.triu_indices(n, 1)
    c = Csr(np.arange(n), v, u, np.ones(len(u)), False)
    began = time.process_time()
    for s in range(5):
        C._levels(c, s)
    assert time.process_time() - began < 0.5  # a loop takes about a second for each


@pytest.mark.parametrize("directed", [False, True])
def test_weighted_closeness_without_searches_from_leaves(spark, directed, monkeypatch):
    rng = np.random.default_rng(7)
    e = [(int(a), int(b), float(rng.integers(0, 4))) for a, b in rng.integers(0, 12, (22, 2))] + [(i, int(rng.integers(0, 12)), float(rng.integers(0, 3))) for i in range(12, 40)]
    e += [(41, 40, 2.0), (42, 43, 0.0), (45, 44, 1.5), (46, 44, 1.5), (45, 44, 3.0)]
    g = Graph(spark.range(48), spark.createDataFrame(e, "src long, dst long, weight double"), directed)
    c, searched, real = C.collect(g), [], C.per_source
    monkeypatch.setattr(C, "per_source", lambda g, sources, *more: searched.append(sources.count()) or real(g, sources, *more))
    for harmonic in (False, True):
        want = {}
        for u in range(48):
            d = c.dijkstra([u])[0]
            d = d[np.isfinite(d)]
            want[u] = (1 / d[d > 0]).sum() / 47 if harmonic else (len(d) - 1) ** 2 / d.sum() / 47 if d.sum() else 0.0
        got = {r.node: r.score for r in C.weighted_closeness(g, harmonic=harmonic).collect()}
        assert got == pytest.approx(want)
    assert searched[0] == 48 if directed else searched[0] < 24
