"""Centralities kept up with batches, against searching anew after each, on random graphs with cycles, several components, nodes that come and nodes that go."""

from collections import deque

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.streaming import kept as K
from graphloom.streaming import updates as U

EVENTS = "seq long, type string, u long, v long, w double"


def graph(spark, pairs, nodes, directed=False):
    v = spark.createDataFrame([(int(i),) for i in nodes], "id long")
    return Graph.from_edges(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long"), directed, v)


def drawn(seed, n, m, directed):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) if directed else (int(max(a, b)), int(min(a, b))) for a, b in rng.integers(0, n, (m, 2)) if a != b}
    return rng, pairs


def search(arcs, s):
    """Distances, counts of shortest paths and shares of a source."""
    d, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
    while queue:
        u = queue.popleft()
        order.append(u)
        for v in arcs.get(u, ()):
            if v not in d:
                d[v], paths[v] = d[u] + 1, 0
                queue.append(v)
            if d[v] == d[u] + 1:
                paths[v] += paths[u]
    own = dict.fromkeys(order, 0.0)
    for u in reversed(order):
        for v in arcs.get(u, ()):
            if d[v] == d[u] + 1:
                own[u] += paths[u] / paths[v] * (1 + own[v])
    own[s] = 0.0
    return d, paths, own


def arcs_of(pairs, directed):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        if not directed:
            out.setdefault(b, set()).add(a)
    return out


def between(pairs, nodes, directed):
    score, arcs = dict.fromkeys(nodes, 0.0), arcs_of(pairs, directed)
    for s in nodes:
        for v, x in search(arcs, s)[2].items():
            score[v] += x
    return score


def batches(rng, pairs, nodes, directed, rounds):
    """Rounds of events, with the pairs and nodes after each: some edges go, some come; a node comes; one loses its edges and goes; one round brings nothing new."""
    pairs, nodes = set(pairs), set(nodes)
    for i in range(rounds):
        gone = [sorted(pairs)[int(j)] for j in rng.choice(len(pairs), 2, replace=False)]
        come = [(int(a), int(b)) for a, b in rng.choice(sorted(nodes), (2, 2)) if a != b]
        events = [("EDGE_REMOVAL", a, b) for a, b in gone] + [("EDGE_ADDITION", a, b) for a, b in come]
        if i == 1:
            events = [("NODE_ADDITION", 500, None), ("NODE_ADDITION", 501, None), ("EDGE_ADDITION", 500, min(nodes))]
        if i == 2:
            x = max(n for n in nodes if n < 500)
            events = [("EDGE_REMOVAL", a, b) for a, b in sorted(pairs) if x in (a, b)] + [("NODE_REMOVAL", x, None)]
        if i == 3:
            a, b = sorted(pairs)[0]
            events = [("EDGE_WEIGHT_UPDATE", a, b), ("EDGE_ADDITION", b, b)]
        for kind, a, b in events:
            key = (a, b) if directed or b is None else (max(a, b), min(a, b))
            if kind == "NODE_ADDITION":
                nodes.add(a)
            elif kind == "NODE_REMOVAL":
                nodes.discard(a)
            elif kind == "EDGE_REMOVAL":
                pairs.discard(key)
            elif kind == "EDGE_ADDITION" and a != b:
                pairs.add(key)
        yield [(j, k, a, b, 1.0) for j, (k, a, b) in enumerate(events)], set(pairs), set(nodes)


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_follows_batches(spark, directed, monkeypatch):
    monkeypatch.setattr(K, "MERGE", 3)
    rng, pairs = drawn(11 + directed, 26, 60, directed)
    nodes = set(range(28))
    watched = U.Watched(graph(spark, pairs, nodes, directed))
    whole, one = K.KeptBetweenness(watched), K.KeptBetweennessOf(watched, 3)
    with pytest.raises(RuntimeError):
        whole.result.count()
    whole.run(), one.run()
    assert {r.node: r.score for r in whole.result.collect()} == pytest.approx(between(pairs, nodes, directed))
    for i, (events, now, there) in enumerate(batches(rng, pairs, nodes, directed, 2 if directed else 4)):
        before, here = arcs_of(pairs, directed), arcs_of(now, directed)
        watched.apply(spark.createDataFrame(events, EVENTS))
        want = between(now, there, directed)
        assert {r.node: r.score for r in whole.result.collect()} == pytest.approx(want, abs=1e-9)
        assert [(r.node, pytest.approx(r.score, abs=1e-9)) for r in one.result.collect()] == [(3, want[3])]
        changed = sum(s not in nodes or search(before, s)[:2] != search(here, s)[:2] for s in there)
        assert changed <= whole.searched <= len(there) and (i != 3 or whole.searched == 0)
        pairs, nodes = now, there


def test_sample_of_sources_and_edges_that_concern_none(spark):
    pairs, nodes = {(1, 0), (2, 1), (3, 2), (3, 0), (11, 10)}, {0, 1, 2, 3, 10, 11}
    watched = U.Watched(graph(spark, pairs, nodes))
    some = K.KeptBetweenness(watched, spark.createDataFrame([(0,), (0,), (77,)], "id long")).run()
    every, absent = K.KeptBetweenness(watched).run(), K.KeptBetweennessOf(watched, 99).run()
    watched.apply(spark.createDataFrame([(0, "EDGE_ADDITION", 10, 11, 1.0), (1, "EDGE_ADDITION", 2, 0, 1.0)], EVENTS))
    now = arcs_of(pairs | {(2, 0)}, False)
    want = {v: 6 * x for v, x in search(now, 0)[2].items()}
    assert {r.node: r.score for r in some.result.where("node < 4").collect()} == pytest.approx(want)
    assert every.searched == 2 and some.searched == 1 and absent.result.isEmpty()  # 1 and 3 are as far from 0 as from 2


def harmonic(pairs, nodes, directed):
    arcs = arcs_of(pairs, directed)
    return {s: sum(1 / d for d in search(arcs, s)[0].values() if d) / (len(nodes) - 1) for s in nodes}


@pytest.mark.parametrize("directed", [False, True])
def test_top_harmonic_follows_batches(spark, directed):
    rng, pairs = drawn(21 + directed, 40, 70, directed)
    nodes = set(range(42))
    watched = U.Watched(graph(spark, pairs, nodes, directed))
    top = K.KeptTopHarmonic(watched, 4, batch=6).run()
    rounds = [(None, pairs, nodes), *batches(rng, pairs, nodes, directed, 1 if directed else 4)]
    for i, (events, now, there) in enumerate(rounds):
        if events:
            watched.apply(spark.createDataFrame(events, EVENTS))
        want = harmonic(now, there, directed)
        best = sorted(want, key=lambda x: (-round(want[x], 9), x))[:4]
        assert [(r.node, pytest.approx(r.score)) for r in top.result.collect()] == [(x, want[x]) for x in best]
        assert top.searched < len(there) and (i != 4 or top.searched == 0)
        bounds = {r.node: r for r in top._bounds.collect()}
        assert set(bounds) == there
        for x, b in bounds.items():
            exact = want[x] * (len(there) - 1)
            assert b.most >= exact - 1e-9 and (not b.exact or b.most == pytest.approx(exact))


def katz(pairs, nodes, directed, alpha):
    order = sorted(nodes)
    at = {x: i for i, x in enumerate(order)}
    a = np.zeros((len(order), len(order)))
    for u, vs in arcs_of(pairs, directed).items():
        for v in vs:
            a[at[u], at[v]] = 1
    return dict(zip(order, np.linalg.solve(np.eye(len(order)) - alpha * a, np.ones(len(order))) - 1, strict=True))


@pytest.mark.parametrize("directed", [False, True])
def test_katz_follows_batches(spark, directed):
    rng, pairs = drawn(31 + directed, 30, 60, directed)
    nodes = set(range(32))
    watched = U.Watched(graph(spark, pairs, nodes, directed))
    top = K.KeptKatz(watched, 5, alpha=0.06, longest=30).run()
    with pytest.raises(ValueError):
        K.KeptKatz(watched, 5, alpha=0.5).run()
    rounds = [(None, pairs, nodes), *batches(rng, pairs, nodes, directed, 2 if directed else 4)]
    for i, (events, now, there) in enumerate(rounds):
        if events:
            watched.apply(spark.createDataFrame(events, EVENTS))
        want = katz(now, there, directed, 0.06)
        got = top.result.collect()
        assert all(r.lower - 1e-9 <= want[r.node] <= r.upper + 1e-9 for r in got)
        assert {r.node for r in got} == set(sorted(want, key=lambda x: (-round(want[x], 9), x))[:5])
        assert i != 4 or top.moved == 0
        walks, arcs = {x: [1.0] for x in there}, arcs_of(now, directed)
        for _ in range(top._length):
            last = {x: w[-1] for x, w in walks.items()}
            for x, w in walks.items():
                w.append(sum(last[v] for v in arcs.get(x, ())))
        assert {r.node: list(r.walks) for r in top._walks.collect()} == walks
