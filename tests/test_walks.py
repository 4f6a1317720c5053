"""Walks of two and three steps: equal to matrix powers, and no walk is written or shuffled."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import meets
from graphloom.operators import prediction as L


def _records(spark) -> int:
    sc = spark.sparkContext
    it = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(it.apply(i).shuffleWriteRecords() for i in range(it.size()))


@pytest.mark.parametrize("directed", [False, True])
def test_neighbours_measure(spark, monkeypatch, directed):
    monkeypatch.setattr(meets, "_parts", lambda entries: 3)
    rng = random.Random(6)
    e = [(b, a, 1.0) for a, b in itertools.combinations(range(25), 2) if rng.random() < 0.3]
    m = np.zeros((26, 26), dtype=int)
    for b, a, _ in e:
        m[b, a] = 1
        m[a, b] = 0 if directed else 1
    g = Graph(spark.range(26), spark.createDataFrame(e, "src long, dst long, weight double"), directed)
    q = spark.createDataFrame(list(itertools.product(range(26), range(26))), "u long, v long")
    common = m.T @ m if directed else m @ m
    want = common + m @ (m @ m.T)
    got = {(r.u, r.v): r.score for r in L.neighbours_measure(g, q.where("u <> v")).collect()}
    assert got == {(u, v): want[u, v] for u in range(26) for v in range(26) if u != v}


def test_walks_are_not_shuffled(spark):
    e = [(b, a, 1.0) for a, b in itertools.combinations(range(40), 2)]  # 780 edges, over a million walks of three steps
    g = Graph(spark.range(40), spark.createDataFrame(e, "src long, dst long, weight double")).materialized()
    before = _records(spark)
    L.neighbours_measure(g, g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).collect()
    assert _records(spark) - before < 20_000


def test_one_owner_in_steps(spark, monkeypatch):
    e = [(0, x) for x in range(1, 30)] + [(y, x) for x in range(1, 30) for y in range(30, 34)]
    arcs = spark.createDataFrame(e + [(b, a) for a, b in e], "u long, x long")
    want = {tuple(r) for r in meets.shared_counts(arcs).collect()}
    m = np.zeros((34, 34), dtype=int)
    for a, b in e:
        m[a, b] = m[b, a] = 1
    assert want == {(a, b, int((m @ m)[a, b])) for a in range(34) for b in range(34) if (m @ m)[a, b]}
    import pyarrow as pa

    asks = pa.table({"node": list(range(34)), "near": [np.flatnonzero(m[a]) for a in range(34)]})
    held = asks.rename_columns(["held", "held_near"])
    whole = meets._step_task(asks, held).to_pydict()
    monkeypatch.setattr(meets, "WEDGES", 3)
    monkeypatch.setattr(meets, "MARKS", 1)
    assert meets._step_task(asks, held).to_pydict() == whole
