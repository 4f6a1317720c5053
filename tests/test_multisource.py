"""Searches from many sources by masks, against plain searches on random graphs with cycles, several components and more sources than a mask holds."""

import math
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import centralities as C
from graphloom.operators import distances as D
from graphloom.operators import multisource as S
from graphloom.operators import paths as X


def drawn(spark, seed, n, m, directed=False):
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, n - 9, (m, 2))] + [(n - 1, n - 2), (n - 2, n - 3), (n - 3, n - 1), (3, 3)]
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    near = {i: set() for i in range(n)}
    for a, b in rows:
        if a != b:
            near[a].add(b)
            if not directed:
                near[b].add(a)
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"), directed, v), near


def search(near, s):
    d, queue = {s: 0}, deque([s])
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in d:
                d[v] = d[u] + 1
                queue.append(v)
    return d


@pytest.mark.parametrize("directed", [False, True])
def test_counts_of_all_sources(spark, directed):
    g, near = drawn(spark, 1, 90, 400, directed)
    want = {(s, h): k for s in near for h, k in Counter(search(near, s).values()).items()}
    assert {(r.source, r.hop): r.nodes for r in S.reach_counts(g).collect()} == want
    some = spark.createDataFrame([(5,), (5,), (80,), (999,)], "id long")
    assert {(r.source, r.hop): r.nodes for r in S.reach_counts(g, some, 2).collect()} == {k: v for k, v in want.items() if k[0] in (5, 80) and k[1] <= 2}
    if directed:
        assert {r.node: r.reachable for r in X.reachable_nodes(g).collect()} == {s: len(search(near, s)) for s in near}
        return
    pairs = Counter(h for (s, h), k in want.items() if h for _ in range(k))
    got = {r.distance: r.pairs for r in X.neighbourhood_function(g).collect()}
    assert got == {h: sum(k for x, k in pairs.items() if x <= h) for h in pairs}
    assert X.mean_ball(g, 2).first()[0] == pytest.approx(sum(k for (_, h), k in want.items() if h <= 2) / 90)
    close = {r.node: r.score for r in D.closeness(g, generalized=True).collect()}
    for s in near:
        d = search(near, s)
        assert close[s] == pytest.approx((len(d) - 1) ** 2 / sum(d.values()) / 89 if len(d) > 1 else 0.0)


@pytest.mark.parametrize(("directed", "harmonic"), [(False, False), (True, True)])
def test_top_closeness_in_batches(spark, directed, harmonic):
    g, near = drawn(spark, 2, 90, 400, directed)
    score = {}
    for s in near:
        d = search(near, s)
        far = sum(d.values())
        score[s] = sum(1 / x for x in d.values() if x) / 89 if harmonic else ((len(d) - 1) ** 2 / far / 89 if far else 0.0)
    want = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:7]
    got = S.top_closeness(g, 7, harmonic, batch=50).collect()
    assert [r.node for r in got] == [i for i, _ in want] and np.allclose([r.score for r in got], [x for _, x in want])
    if harmonic:
        assert S.top_closeness(g, 0).count() == 0 and S.top_closeness(g, 400, harmonic).count() == 90


def test_pruned_searches_reach_less(spark, monkeypatch):
    """Of a star with long tails, later batches are not searched from."""
    rows = [(0, i) for i in range(1, 90)] + [(i, i + 1) for i in range(100, 104)] + [(1, 100)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    begun, real = [], S.placed
    monkeypatch.setattr(S, "placed", lambda s: begun.append(s.count()) or real(s))
    assert [r.node for r in S.top_closeness(g, 1, batch=30).collect()] == [0]
    assert sum(begun) < g.vertices.count() / 2


@pytest.mark.parametrize("harmonic", [False, True])
def test_leaves_of_small_stars_are_not_searched_from(spark, monkeypatch, harmonic):
    """Trees of a root, hubs and leaves: a leaf of a large tree promises less than the root of a small one, once its hub's degree is known."""
    rows = [e for t, k in ((0, 9), (1000, 8)) for h in range(t + 1, t + 6) for e in [(t, h), *((h, h * 10 + 10000 + i) for i in range(k))]]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    begun, real = [], S.placed
    monkeypatch.setattr(S, "placed", lambda s: begun.append(s.count()) or real(s))
    got = [r.node for r in S.top_closeness(g, 2, harmonic, batch=15).collect()]
    assert got == [0, 1000] and sum(begun) < g.vertices.count() / 2


@pytest.mark.parametrize("harmonic", [False, True])
def test_groups_are_greedy(spark, harmonic):
    g, near = drawn(spark, 3, 70, 250)
    n, dist, want = 70, {}, []
    for _ in range(2):
        def worth(u):
            d = search(near, u)
            both = {v: min(dist.get(v, 10**9), d.get(v, 10**9)) for v in near}
            return sum(1 / x for x in both.values() if 0 < x < 10**9) if harmonic else sum(dist.get(v, n) - min(both[v], n) for v in near)

        u = min((x for x in near if x not in want), key=lambda x: (-round(worth(x), 9), x))
        want.append(u)
        for v, x in search(near, u).items():
            dist[v] = min(dist.get(v, 10**9), x)
    assert [r.node for r in S.group_closeness(g, 2, harmonic).orderBy("position").collect()] == want


def test_sums_of_pivots(spark):
    g, near = drawn(spark, 4, 150, 400)
    pivots = list(range(0, 150, 2))
    got = {r.node: r for r in S.pivot_sums(g, spark.createDataFrame([(p,) for p in pivots], "id long")).collect()}
    for v in near:
        d = {p: search(near, p)[v] for p in pivots if v in search(near, p)}
        if d:
            h = min(d.values())
            assert (got[v].pivots, got[v].total, got[v].hops, got[v].nearest) == (len(d), sum(d.values()), h, min(p for p in d if d[p] == h))
        else:
            assert v not in got


def test_no_graph_is_broadcast(spark):
    g, _ = drawn(spark, 5, 30, 80)
    none = Graph(g.vertices.limit(0), g.edges.limit(0))
    assert S.reach_counts(none).count() == 0 and S.top_closeness(none, 3).count() == 0 and S.group_closeness(none, 2).count() == 0
    assert "Python" not in X.effective_diameter(g)._jdf.queryExecution().toString()
    assert C.approx_closeness(g, 10).where(F.col("score") < 0).count() == 0


def test_balls_without_searches_from_leaves(spark, monkeypatch):
    e = [(1, 0), (2, 0), (3, 0), (4, 3), (5, 4), (6, 4), (9, 8), (12, 10), (12, 11), (13, 12), (14, 13), (13, 11)]
    g = Graph(spark.range(16), spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, weight double"))
    near = {v: {b if a == v else a for a, b in e if v in (a, b)} for v in range(16)}
    whole, asked = S.placed, []
    monkeypatch.setattr(S, "placed", lambda x: asked.append({r.id for r in x.collect()}) or whole(x))
    for r in (2, 3, 4):
        asked.clear()
        assert X.mean_ball(g, r).first()[0] == pytest.approx(sum(sum(h <= r for h in search(near, s).values()) for s in near) / 16)
        assert asked == [{0, 3, 4, 7, 8, 11, 12, 13, 15}]
    none = Graph(g.vertices.limit(0), g.edges.limit(0))
    assert X.mean_ball(none, 2).first()[0] is None


@pytest.mark.parametrize("directed", [False, True])
def test_effective_diameter_searches_only_where_enough_is_near(spark, monkeypatch, directed):
    e = [(a, b) for a in range(12) for b in range(a) if a - b < 3 or b == 0] + [(a + 100, 100) for a in range(1, 8)]
    g = Graph(spark.range(12).union(spark.range(100, 108)), spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, weight double"), directed)
    nodes = [*range(12), *range(100, 108)]
    near = {v: {b for a, b in e if a == v} | (set() if directed else {a for a, b in e if b == v}) for v in nodes}
    whole, asked = S.placed, []
    monkeypatch.setattr(S, "placed", lambda x: asked.append({r.id for r in x.collect()}) or whole(x))
    for ratio in (0.2, 0.45, 0.6) if not directed else (0.01, 0.3, 0.7):
        need = max(math.ceil(ratio * 20), 1)
        first = [min((h for h in range(20) if sum(x <= h for x in search(near, s).values()) >= need), default=None) for s in nodes]
        first = [h for h in first if h is not None]
        asked.clear()
        assert X.effective_diameter(g, ratio).first()[0] == (pytest.approx(sum(first) / len(first)) if first else None)
        assert not any(len(near[v]) + 1 >= need for a in asked for v in a) and (need <= 8 or not any(v >= 100 for a in asked for v in a))
        assert need <= 12 or not asked
