"""Work and memory of a task that don't grow with the input: partitions, ranks, cores and masks."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph, co_purchase
from graphloom.operators import community as M
from graphloom.operators import iterative as I
from graphloom.operators import matchings as B
from graphloom.operators import paths as X
from graphloom.operators import prediction as L
from graphloom.operators import randomize as R
from graphloom.operators import toolbox as T


def _graph(spark, n=30, p=0.2, seed=3):
    rng = random.Random(seed)
    e = [(b, a, 1.0) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]
    return Graph(spark.range(n), spark.createDataFrame(e, "src long, dst long, weight double")), e


def test_k_core_only_peels(spark, monkeypatch):
    g, e = _graph(spark)
    core = {r.node: r.core for r in I.core_numbers(g).collect()}
    monkeypatch.setattr(I, "core_numbers", lambda g: pytest.fail("all cores are not needed"))
    for k in (0, 3, 5, 99):
        comp = {v: v for v in range(30)}
        for _ in range(30):
            for a, b, _w in e:
                if core[a] >= k and core[b] >= k:
                    comp[a] = comp[b] = min(comp[a], comp[b])
        assert {r.node: r.community for r in M.k_core_communities(g, k).collect()} == comp


def test_ranks_number_different_values_only(spark, monkeypatch):
    whole, rows = T.numbered, []
    monkeypatch.setattr(T, "numbered", lambda df, *a, **k: rows.append(df.count()) or whole(df, *a, **k))
    monkeypatch.setattr(T, "RANKS", 3)
    x = [float(v) for v in [1] * 50 + [2] * 7 + [0, 5, 5, 9, 8, 7, 7, 7, -1]]
    got = T.ranked(spark.createDataFrame([(v,) for v in x], "value double")).collect()
    assert sorted((r.value, r["rank"]) for r in got) == sorted((v, sum(y < v for y in x) + (x.count(v) + 1) / 2) for v in x)
    assert rows == [len(set(x))]


def test_many_links_are_not_sorted_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(L, "FEW", 3)
    rng = random.Random(1)
    s = [(u, v, float(rng.randrange(4))) for u in range(12) for v in range(12)]
    df = spark.createDataFrame(s, "u long, v long, score double")
    for k in (0, 3, 50, 144):
        out = L.links_by_count(df, k)
        assert sorted(map(tuple, out.collect())) == sorted((u, v) for u, v, _ in sorted(s, key=lambda r: (-r[2], r[0], r[1]))[:k])
    assert "Limit" not in L.links_by_count(df, 50)._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_grow_with_rows(spark, monkeypatch):
    from graphloom.plans import spread

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, co_purchase(spark, d).edges.collect()))
    monkeypatch.setattr(spread, "ROWS", 500)
    e = co_purchase(spark, d).edges
    assert e.rdd.getNumPartitions() >= 20 and sorted(map(tuple, e.collect())) == want


def test_contacts_grow_with_rows(spark, monkeypatch):
    from graphloom.plans import spread

    g, _ = _graph(spark)
    want = sorted(map(tuple, R.seir(g, 3, 0.5, 1, 2, 0).collect()))
    monkeypatch.setattr(spread, "ROWS", 10)
    plans, keep = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name="t", by=None: plans.append((name, df.rdd.getNumPartitions())) or keep(df, name, by))
    assert sorted(map(tuple, R.seir(g, 3, 0.5, 1, 2, 0).collect())) == want
    assert dict(plans)["arcs"] > 4


def test_masks_are_not_broadcast(spark, monkeypatch):
    g, _ = _graph(spark)
    plans, keep = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, name="t", by=None: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name, by))
    X.approximate_neighbourhood_function(g).collect()
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for n, p in plans if n == "anf")


def test_equal_weights_do_not_wait_for_one_another(spark, monkeypatch):
    rows = [(i + 1, i, 1.0) for i in range(60)]
    g, written, whole = Graph(spark.range(61), spark.createDataFrame(rows, "src long, dst long, weight double")), [], B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, name="t", by=None: written.append(name) or whole(df, name, by))
    got = [(r.src, r.dst) for r in B.b_matching(g).collect()]
    assert written.count("won") < 15  # by ids, 30 rounds
    taken = {x for e in got for x in e}
    assert len(taken) == 2 * len(got) and all(a in taken or b in taken for a, b, _ in rows)


def _simple_and_same_degrees(before, after, directed=False):
    a, b = ([(r.src, r.dst) for r in e.collect()] for e in (before, after))
    assert all(x != y and (directed or x > y) for x, y in b) and len(set(b)) == len(b) == len(a) and set(a) != set(b)
    count = lambda e, i: sorted(x[i] for x in e)
    if directed:
        assert count(a, 0) == count(b, 0) and count(a, 1) == count(b, 1)
    else:
        assert sorted(x for e in a for x in e) == sorted(x for e in b for x in e)


def test_switches_and_trades_in_tables(spark, monkeypatch):
    g, e = _graph(spark, 31, 0.3)
    monkeypatch.setattr(R, "LOCAL_EDGES", 10)
    monkeypatch.setattr(R, "collect", lambda g: pytest.fail("the graph comes to the driver"))
    weighed = Graph(g.vertices, g.edges.withColumn("weight", F.col("src") * 1.0))
    h = R.edge_switching(weighed, 2.5)
    _simple_and_same_degrees(g.edges, h.edges)
    assert sorted(r.weight for r in h.edges.collect()) == sorted(float(a) for a, _, _ in e)
    arcs = Graph(g.vertices, g.edges.where("(src + dst) % 2 = 0").union(g.edges.where("src % 3 = 0").select("dst", "src", "weight")).distinct(), directed=True)
    _simple_and_same_degrees(arcs.edges, R.edge_switching(arcs, 2.0).edges, directed=True)
    t = R.global_curveball(g, 2, shuffle=False)
    _simple_and_same_degrees(g.edges, t.edges)
    assert {(r.src, r.dst) for r in t.edges.collect()} == {(r.src, r.dst) for r in R.global_curveball(g, 2, shuffle=False).edges.collect()}


def test_switches_and_trades_of_graphs_that_allow_none(spark, monkeypatch):
    monkeypatch.setattr(R, "LOCAL_EDGES", 0)
    whole = [(a, b, 1.0) for a in range(5) for b in range(a)]
    g = Graph(spark.range(7), spark.createDataFrame(whole, "src long, dst long, weight double"))
    for h in (R.edge_switching(g, 1.0), R.global_curveball(g, 1, shuffle=False)):
        assert h.edges.count() == 10
    star = Graph(spark.range(5), spark.createDataFrame([(a, 0, 1.0) for a in range(1, 5)], "src long, dst long, weight double"))
    assert {(r.src, r.dst) for r in R.edge_switching(star, 2.0).edges.collect()} == {(a, 0) for a in range(1, 5)}
