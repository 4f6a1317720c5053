"""What lists share: equal to brute force, and no wedge is written or shuffled."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import meets
from graphloom.operators import edge_scores as E
from graphloom.operators import prediction as L
from graphloom.operators import triangles as T


def _graph(spark, edges, n):
    return Graph(spark.range(n), spark.createDataFrame([(max(e), min(e), 1.0) for e in edges], "src long, dst long, weight double"))


def _records(spark) -> int:
    sc = spark.sparkContext
    it = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(it.apply(i).shuffleWriteRecords() for i in range(it.size()))


def _random(seed, n=40, p=0.25):
    rng = random.Random(seed)
    return [e for e in itertools.combinations(range(n), 2) if rng.random() < p]


@pytest.fixture
def steps(monkeypatch):
    """Several parts, and steps of few wedges and marks."""
    monkeypatch.setattr(meets, "_parts", lambda entries: 3)


OPERATORS = {
    "local_clustering": T.local_clustering,
    "global_clustering": T.global_clustering,
    "by_triangles": lambda g: E.by_triangles(g, 3).edges,
    "chance_corrected": E.chance_corrected,
    "local_similarity": E.local_similarity,
    "simmelian_parametric": lambda g: E.simmelian_parametric(g, 10, 3).edges,
    "simmelian_overlap": lambda g: E.simmelian_overlap(E._triangles(g), 100),
    "prefix_jaccard": lambda g: E.prefix_jaccard(E._triangles(g)),
    "simmelian_nonparametric": lambda g: E.simmelian_nonparametric(g, 0.5).edges,
    "adjusted_rand": lambda g: L.adjusted_rand_index(g, g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_wedges_are_not_shuffled(spark, name):
    g = _graph(spark, itertools.combinations(range(60), 2), 60).materialized()  # 34220 wedges and triangles, 102660 paths over the ends of edges
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _records(spark)
        OPERATORS[name](g).collect()
        assert _records(spark) - before < 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_triangles_in_parts(spark, steps):
    edges = _random(1) + [(0, 1), (0, 1)]  # parallel edges count each
    g = _graph(spark, edges, 40)
    want = {}
    for x, y, z in itertools.combinations(range(40), 3):
        k = edges.count((x, y)) * edges.count((y, z)) * edges.count((x, z))
        if k:
            want[x, y, z] = k
    got = {}
    for r in T.triangles(g).collect():
        got[tuple(sorted(r))] = got.get(tuple(sorted(r)), 0) + 1
    assert got == want
    assert {r.node: r.triangles for r in T.triangles_by_node(g).collect()} == {v: sum(k for t, k in want.items() if v in t) for v in range(40)}
    assert {(r.src, r.dst): r.triangles for r in T.triangles_by_edge(g).collect()} == {(b, a): sum(k for t, k in want.items() if a in t and b in t) for a, b in edges}


def test_pairs_in_parts(spark, steps):
    edges = _random(2)
    g = _graph(spark, edges, 40)
    near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in range(40)}
    q = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "u long, v long")
    got = {(r.u, r.v): r.common for r in L.predict(g, q).collect()}
    assert got == {(u, v): len(near[u] & near[v]) for u, v in itertools.combinations(range(40), 2)}


def test_prefix_jaccard_in_parts(spark, steps):
    edges = _random(3, 30)
    rng = random.Random(4)
    score = {e: rng.randrange(4) for e in edges}  # ties
    s = spark.createDataFrame([(b, a, float(x)) for (a, b), x in score.items()], "src long, dst long, score double")
    rank = {}
    for v in range(30):
        mine = {a + b - v: x for (a, b), x in score.items() if v in (a, b)}
        rank[v] = {u: sum(y > x for y in mine.values()) for u, x in mine.items()}
    for r in E.prefix_jaccard(s).collect():
        best = 0.0
        for k in range(30):
            a, b = ({x for x, y in rank[v].items() if y <= k and x not in (r.src, r.dst)} for v in (r.src, r.dst))
            best = max(best, len(a & b) / len(a | b) if a | b else 0.0)
        assert r.score == pytest.approx(best)


def test_long_lists_in_steps(monkeypatch):
    """Steps of one wedge and one mark give the same as one step."""
    import numpy as np
    import pyarrow as pa

    edges = np.array(_random(5))
    lists = pa.table({"node": np.unique(edges[:, 0]), "near": [edges[edges[:, 0] == a, 1] for a in np.unique(edges[:, 0])]})
    held = lists.rename_columns(["held", "held_near"])
    whole = {w: meets._triangle_task(w)(lists, held).num_rows for w in ("triples", "nodes")}
    rows = meets._triangle_task("triples")(lists, held).to_pydict()
    monkeypatch.setattr(meets, "MARKS", 1)
    monkeypatch.setattr(meets, "WEDGES", 1)
    assert meets._triangle_task("triples")(lists, held).to_pydict() == rows
    assert whole["nodes"] == meets._triangle_task("nodes")(lists, held).num_rows


def test_lists_travel_packed():
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.integers(-(10**k), 10**k, n)) for k in range(1, 19) for n in (0, 1, 50)] + [np.array([-(2**63), -1, 0, 2**63 - 1])]
    lengths, values = np.array([len(x) for x in lists]), np.concatenate(lists)
    t = pa.table({"near": meets._packed(lengths, values)}).slice(1)
    back = meets._unpacked(t, "near")
    assert back[0].tolist() == lengths[1:].tolist() and back[1].tolist() == values.tolist()
    near = np.sort(rng.choice(20000, (100, 60)), axis=1)
    assert meets._packed(np.full(100, 60), near.reshape(-1)).nbytes < 60 * 100 * 4 / 2


def test_graphs_are_built_once(spark):
    e = spark.range(200).select((F.col("id") % 19 + 20).alias("src"), (F.col("id") % 7).alias("dst"), F.lit(1.0).alias("weight")).distinct()
    e = e.union(spark.range(6).select(F.col("id") + 1, "id", F.lit(1.0)))
    g = Graph(spark.range(40), e)
    for name, out in (("by_triangles", E.by_triangles(g, 1).edges), ("simmelian_parametric", E.simmelian_parametric(g, 3, 1).edges), ("chance_corrected", E.chance_corrected(g)), ("local_similarity", E.local_similarity(g))):
        assert "Range (0, 200" not in out._jdf.queryExecution().optimizedPlan().toString(), name
