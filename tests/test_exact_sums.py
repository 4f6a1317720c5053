"""Sums of 1 / ln(degree) are rounded once, so that no order of arrival shows."""

from __future__ import annotations

import itertools
import math
import random

from graphloom.graph import Graph
from graphloom.operators import paths as X


def test_adamic_adar_is_rounded_once(spark):
    rng = random.Random(9)
    edges = [e for e in itertools.combinations(range(60), 2) if rng.random() < 0.5]
    near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in range(60)}
    g = Graph(spark.range(60), spark.createDataFrame([(b, a, 1.0) for a, b in edges], "src long, dst long, weight double"))
    want = {(b, a): 1 / math.fsum(1 / math.log(len(near[x])) for x in near[a] & near[b]) for a, b in edges if near[a] & near[b]}
    got = {(r.src, r.dst): r.distance for r in X.adamic_adar_distance(g).collect()}
    assert len(got) == len(edges) and {k: got[k] for k in want} == want
