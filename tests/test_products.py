"""Power iterations by blocks against plain arrays, and what a round shuffles."""

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.kernels import products as P
from graphloom.operators import iterative as I


def drawn(spark, directed, n=40, m=120):
    rng = np.random.default_rng(5)
    rows = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, n - 4, m), rng.integers(0, n - 4, m), rng.integers(1, 5, m), strict=True) if directed or a >= b}
    a = np.zeros((n, n))  # a[v, u]: weight of the arc from u to v
    for (u, v), w in rows.items():
        a[v, u] += w
        if not directed and u != v:
            a[u, v] += w
    e = spark.createDataFrame([(u * 7 - 50, v * 7 - 50, w) for (u, v), w in rows.items()], "src long, dst long, weight double")
    return Graph(spark.createDataFrame([(i * 7 - 50,) for i in range(n)], "id long"), e, directed), a


@pytest.mark.parametrize("directed", [False, True])
def test_rounds_by_blocks(spark, monkeypatch, directed):
    monkeypatch.setattr(P, "BLOCK", 30)
    monkeypatch.setattr(P, "ROW", 7)
    plans, keep = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name="t", by=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name, by))
    g, a = drawn(spark, directed)
    n = len(a)
    score = lambda df: np.array([r.score for r in df.orderBy("node").collect()])
    x, out = np.full(n, 1 / n), a.sum(0)
    for _ in range(3):
        x = 0.15 / n + 0.85 * a @ np.divide(x, out, out=np.zeros(n), where=out > 0)
    assert score(I.pagerank(g, iterations=3, tol=0.0)) == pytest.approx(x / x.sum() if directed else x, rel=1e-12)
    # arcs lie where they are multiplied: nothing but lists of parts is exchanged
    rounds = [p for p in plans if "Bucketed: true" in p]
    assert len(rounds) == 3
    for p in rounds:
        lines = p.splitlines()
        scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, at = [], depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
            if "along" in line:
                break
        assert any("along" in x for x in above) and not any("Exchange" in x for x in above)
    if directed:
        return
    x = np.ones(n)
    for _ in range(2):
        x = a @ x
        x /= np.linalg.norm(x)
    assert score(I.eigenvector(g, iterations=2)) == pytest.approx(x, abs=1e-12)
    x = np.ones(n)
    for _ in range(2):
        x = 0.1 + 0.01 * a @ (1 + x)
    assert score(I.katz(g, 0.01, iterations=2)) == pytest.approx(x / np.linalg.norm(x), rel=1e-12)


def test_sinks_and_ends_that_are_no_vertices(spark):
    g = Graph(spark.range(3), spark.createDataFrame([(0, 1, 1.0), (0, 9, 3.0), (9, 2, 1.0)], "src long, dst long, weight double"), True)
    got = {r.node: r.score for r in I.pagerank(g, iterations=1, distribute_sinks=True).collect()}
    base = 0.05 + 0.85 / 3 * 2 / 3  # both 1 and 2 are sinks
    assert got == pytest.approx({0: base, 1: base + 0.85 / 3 / 4, 2: base})
