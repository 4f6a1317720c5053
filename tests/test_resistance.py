"""Effective resistances: equal to a dense pseudo-inverse, whatever holds a component, with nothing of the graph on the driver."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.kernels import csr, spectral
from graphloom.operators import centralities as C
from graphloom.operators import paths as X
from graphloom.operators import resistance


def _graph(spark):
    rng = random.Random(5)
    e = [(b, a, float(rng.randint(1, 4))) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.4]
    e += [(b, a, 2.0) for a, b in [(20, 21), (21, 22), (20, 22), (22, 23)]] + [(30, 30, 5.0)]
    return Graph(spark.range(32), spark.createDataFrame(e, "src long, dst long, weight double")), e


def _dense(e):
    lap = np.zeros((32, 32))
    for a, b, w in e:
        if a != b:
            lap[[a, b], [a, b]] += w
            lap[[a, b], [b, a]] -= w
    return np.linalg.pinv(lap), np.trace(lap)


@pytest.mark.parametrize("most", [6000, 5])
def test_no_graph_on_the_driver(spark, monkeypatch, most):
    monkeypatch.setattr(csr, "MAX_EDGES", 0)
    monkeypatch.setattr(spectral, "SPECTRAL", 0)
    monkeypatch.setattr(resistance, "DENSE", most)
    g, e = _graph(spark)
    inv, volume = _dense(e)
    r = lambda a, b: inv[a, a] + inv[b, b] - 2 * inv[a, b]
    got = {(x["src"], x["dst"]): x["score"] for x in C.spanning_edge(g).collect()}
    assert got == pytest.approx({(a, b): r(a, b) * w for a, b, w in e}, abs=1e-9)
    pairs = [(0, 11), (11, 0), (3, 21), (5, 31), (7, 7), (31, 31)]
    got = {(x["u"], x["v"]): x["distance"] for x in X.commute_distance(g, spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == pytest.approx({(a, b): np.sqrt(max(r(a, b), 0) * volume) for a, b in pairs}, abs=1e-6)


def test_inverse_in_place():
    a = np.random.default_rng(1).random((70, 70))
    a = a @ a.T + 70 * np.eye(70)
    want = np.linalg.inv(a)
    spectral.inverse_in_place(a, 16)
    assert np.allclose(a, want, atol=1e-12)
