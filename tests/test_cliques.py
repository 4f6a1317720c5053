"""Maximal cliques against brute force, and what of a graph they gather."""

import itertools
import random

from graphloom.graph import Graph
from graphloom.operators import matchings as B


def brute(n, e):
    near = {v: {b if a == v else a for a, b in e if v in (a, b) and a != b} for v in range(n)}
    own = [set(q) for k in range(1, n + 1) for q in itertools.combinations(range(n), k) if all(b in near[a] for a, b in itertools.combinations(q, 2))]
    return {tuple(sorted(q)) for q in own if not any(q < p for p in own)}


def test_only_edges_of_triangles_are_gathered(spark, monkeypatch):
    whole, seen = B.collect, []
    monkeypatch.setattr(B, "collect", lambda g: seen.append({(r.src, r.dst) for r in g.edges.collect()}) or whole(g))
    rng = random.Random(4)
    for p in (0.0, 0.15, 0.4):
        e = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in itertools.combinations(range(11), 2) if rng.random() < p]
        e += [(3, 3), *e[:2]]
        g = Graph(spark.range(11), spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, weight double"))
        assert sorted(tuple(r.clique) for r in B.maximal_cliques(g).collect()) == sorted(brute(11, e))
    for s in seen:
        assert all(any({(max(a, c), min(a, c)), (max(b, c), min(b, c))} <= s for c in range(11)) for a, b in s)
    seen.clear()
    star = Graph(spark.range(30), spark.range(1, 30).selectExpr("id AS src", "0L AS dst", "1D AS weight"))
    assert B.maximal_cliques(star).count() == 29 and not seen
