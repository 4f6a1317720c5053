"""Operators without SQL, against golden values, brute force or what must hold, on small graphs."""

import itertools
from math import isclose

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels import modularity as MK
from graphloom.kernels.csr import TooLarge, collect
from graphloom.operators import algebra as A
from graphloom.operators import blocks as K
from graphloom.operators import centralities as C
from graphloom.operators import community as M
from graphloom.operators import distances as D
from graphloom.operators import edge_scores as E
from graphloom.operators import iterative as I
from graphloom.operators import local as S
from graphloom.operators import matchings as B
from graphloom.operators import partitions as P
from graphloom.operators import paths as X
from graphloom.operators import prediction as L
from graphloom.operators import randomize as R
from graphloom.operators import toolbox as T
from graphloom.streaming import updates as U

T6 = [(0, 2), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5)]
W8 = [(0, 2, 3.0), (1, 2, 2.0), (2, 3, 3.0), (2, 4, 2.0), (2, 5, 1.5), (3, 5, 3.0), (4, 5, 2.0), (5, 6, 3.0), (5, 7, 2.0)]


def graph(spark, edges, n=None, directed=False):
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in edges]
    n = n if n is not None else max((max(a, b) for a, b, _ in rows), default=-1) + 1
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight double"), directed, vertices=spark.range(n), multi="keep")


def ring_of_cliques(k, size):
    e = []
    for c in range(k):
        e += [(c * size + i, c * size + j) for i in range(size) for j in range(i)]
        e.append((c * size, ((c + 1) % k) * size + 1))
    return e


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def scores(df):
    return {r["node"]: r["score"] for r in df.collect()}


@pytest.fixture(scope="module")
def t6(spark):
    return graph(spark, T6)


@pytest.fixture(scope="module")
def cliques(spark):
    return graph(spark, ring_of_cliques(6, 5))


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_louvain_and_leiden_find_cliques(spark, cliques, monkeypatch, limit):
    monkeypatch.setattr(M, "LOCAL_EDGES", limit)
    want = {frozenset(range(c * 5, c * 5 + 5)) for c in range(6)}
    for f in (M.louvain, M.leiden):
        got = {}
        for r in f(cliques).collect():
            got.setdefault(r["community"], set()).add(r["node"])
        if limit:
            assert {frozenset(x) for x in got.values()} == want
        else:  # relational rounds: as good a partition, of all nodes
            assert sum(map(len, got.values())) == 30 and len(got) <= 15


def test_array_moves_reach_known_modularity():
    rng = np.random.default_rng(0)
    own = np.arange(2000) // 50
    u, v = [], []
    for c in range(40):
        x = np.flatnonzero(own == c)
        p = rng.integers(0, 50, (250, 2))
        u += x[p[:, 0]].tolist()
        v += x[p[:, 1]].tolist()
    p = rng.integers(0, 2000, (1500, 2))
    u, v = np.array(u + p[:, 0].tolist()), np.array(v + p[:, 1].tolist())
    w = np.ones(len(u))
    true = MK.modularity(u, v, w, own)
    for leiden in (False, True):
        c = MK.louvain(u, v, w, 2000, leiden=leiden)
        assert MK.modularity(u, v, w, c) > true - 0.02


def test_other_detectors_on_cliques(spark, cliques):
    for p in (M.agglomerative(cliques), M.louvain_map_equation(cliques), M.label_propagation_by_degree(cliques), M.spectral_partition(cliques, 6)):
        assert P.modularity(cliques, p).first()[0] > 0.4
    assert M.map_equation(cliques, M.louvain_map_equation(cliques)).first()[0] < M.map_equation(cliques, P.one_community(cliques)).first()[0]
    cut = M.cut_clustering(cliques, 0.3)
    assert P.community_sizes(cut).agg(F.min("size")).first()[0] == 5
    core = M.k_core_communities(cliques, 4)
    assert core.where("node <> community").count() > 0
    empty = graph(spark, [], 3)
    assert M.louvain(empty).count() == 3 and M.leiden(empty).count() == 3


def test_betweenness_by_weight_and_by_edge(spark, t6):
    w8 = graph(spark, W8)
    got = scores(C.weighted_betweenness(w8))
    assert np.allclose([got[i] for i in range(8)], [0, 0, 23, 0, 0, 23, 0, 0], atol=1e-3)
    assert np.allclose([scores(C.weighted_betweenness(t6, weighted=False))[i] for i in range(6)], [0, 0, 15, 3, 3, 1])
    path = graph(spark, [(0, 1), (1, 2), (2, 3)])
    assert {(r.src, r.dst): r.score for r in C.edge_betweenness(path).collect()} == {(1, 0): 6.0, (2, 1): 8.0, (3, 2): 6.0}


def test_sampled_centralities_are_near_exact_ones(spark, t6):
    exact = scores(D.betweenness(t6))
    n = 6
    for got in (C.approx_betweenness(t6, 0.1), C.kadabra_betweenness(t6, 0.1)):
        assert all(abs(s - exact[v] / (n * (n - 1))) <= 0.12 for v, s in scores(got).items())
    assert [r.node for r in C.kadabra_betweenness(t6, 0.1, k=1).collect()] == [2]
    assert scores(C.estimate_betweenness(t6, 6)) == pytest.approx(exact)
    golden = [0.1, 0.1, 0.166667, 0.125, 0.125, 0.1]
    close = scores(C.approx_closeness(t6, 6))
    assert all(abs(close[i] - golden[i]) <= 0.2 for i in range(6))
    walk = scores(C.k_path(t6, 0.2, 3))
    assert max(walk, key=walk.get) == 2
    sub = scores(D.closeness(t6, generalized=True))
    assert [(r.node, r.score) for r in C.top_closeness(t6, 2).collect()] == sorted(sub.items(), key=lambda x: (-x[1], x[0]))[:2]


def test_currents(spark, t6):
    c = collect(t6)
    lap = np.zeros((6, 6))
    for a, b in T6:
        lap[a, a] += 1
        lap[b, b] += 1
        lap[a, b] -= 1
        lap[b, a] -= 1
    inv = np.linalg.pinv(lap)
    r = lambda a, b: inv[a, a] + inv[b, b] - 2 * inv[a, b]
    edge = {(x.src, x.dst): x.score for x in C.spanning_edge(t6).collect()}
    assert all(isclose(edge[max(a, b), min(a, b)], r(a, b), abs_tol=1e-9) for a, b in T6) and isclose(sum(edge.values()), 5, abs_tol=1e-9)
    near = {(x.src, x.dst): x.score for x in C.approx_spanning_edge(t6, 0.1).collect()}
    assert all(abs(near[k] - edge[k]) <= 0.15 for k in edge)
    want = {u: 5 / sum(r(u, v) for v in range(6)) for u in range(6)}
    assert scores(C.electrical_closeness(t6)) == pytest.approx(want)
    assert all(abs(s - want[u]) <= 0.2 * want[u] for u, s in scores(C.electrical_closeness(t6, 0.2)).items())
    forest = np.linalg.inv(np.eye(6) + lap)
    f = {u: 6 / sum(forest[u, u] + forest[v, v] - 2 * forest[u, v] for v in range(6)) for u in range(6)}
    assert scores(C.forest_closeness(t6)) == pytest.approx(f)
    assert X.commute_distance(t6).where("u = 2 AND v = 0").first().distance == pytest.approx(np.sqrt(12 * r(0, 2)))
    tree = X.random_spanning_forest(t6).collect()
    assert len(tree) == 5 and {(x.src, x.dst) for x in tree} <= set(edge)
    b = spark.createDataFrame([(0, 1.0), (5, -1.0)], "node long, v double")
    for method in ("cg", "jacobi_cg", "gauss_seidel", "multilevel"):
        x = {q.node: q.x for q in A.solved(t6, b, method, 1e-9).collect()}
        assert isclose(x[0] - x[5], r(0, 5), abs_tol=1e-5)
    assert c.n == 6


def test_groups(spark, t6):
    far = lambda group: sum(min(d[u][v] for u in group) for v in range(6))
    d = {r.source: {} for r in D.distances(t6).collect()}
    for r in D.distances(t6).collect():
        d[r.source][r.node] = r.distance
    best = min(itertools.combinations(range(6), 2), key=far)
    got = [r.node for r in C.group_closeness(t6, 2).orderBy("position").collect()]
    assert got[0] == 2 and far(got) <= far(best) + 1
    moved = [r.node for r in C.local_search_group(t6, [0, 1], anywhere=True).collect()]
    assert far(moved) == far(best)
    grown = [r.node for r in C.local_search_group(t6, [0, 1], grow=1).collect()]
    assert far(grown) <= far([0, 1])
    assert [r.node for r in C.group_degree(t6, 2).orderBy("position").collect()][0] == 2
    assert [r.node for r in C.approx_group_betweenness(t6, 1, 0.2).collect()] == [2]
    assert [r.node for r in C.walk_group(t6, 1).collect()] == [2]
    assert C.group_value(t6, [2], harmonic=True) == pytest.approx(4 + 0.5)
    assert [r.node for r in C.top_katz(t6, 1).collect()] == [2]


def test_permanence_and_complex_paths(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)])
    p = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "node long, community long")
    got = scores(C.permanence(g, p))
    assert got[0] == pytest.approx(2 / 1 / 2 - 0) and got[2] == pytest.approx(2 / 1 / 3 - 0) and got[3] == pytest.approx(1 / 3 * 0 + 1 / 1 / 2 - 1)
    when = {r.node: r["round"] for r in C.complex_path_lengths(g, 2, 0).collect()}
    assert when == {0: 0, 1: 0, 2: 0}
    assert {r.node: r["round"] for r in C.complex_path_lengths(g, 1, 0).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def test_searches(spark):
    edges = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (2, 3, 8), (4, 5, 1)]
    g = graph(spark, edges, directed=True)
    want = {0: 0.0, 1: 3.0, 2: 1.0, 3: 8.0}
    assert {r.node: r.distance for r in X.bellman_ford(g, 0).collect()} == want
    assert {r.node: r.distance for r in A.algebraic_bellman_ford(g, 0).collect()} == want
    assert {r.target: r.distance for r in X.apsp(g).where("source = 0").collect()} == want
    assert [r.node for r in X.a_star(g, 0, 3, lambda v: 0.0).collect()] == [0, 2, 1, 3] == [r.node for r in X.shortest_path(g, 0, 3).orderBy("position").collect()]
    assert list(X.nearest_first(g, [0])) == [(0, 0.0), (2, 1.0), (1, 3.0), (3, 8.0)] and [v for v, _ in X.nearest_first(g, [0], {2})] == [0, 1, 3]
    bad = graph(spark, [(0, 1, 1), (1, 2, -3), (2, 1, 1), (2, 3, 1)], directed=True)
    assert {r.node: r.negative for r in X.bellman_ford(bad, 0).collect()} == {0: False, 1: True, 2: True, 3: True}
    assert {r.source for r in X.floyd_warshall(bad).where("negative").collect()} >= {1, 2}
    with pytest.raises(ValueError):
        A.algebraic_bellman_ford(bad, 0)
    two = graph(spark, [(0, 1), (1, 3), (0, 2), (2, 3), (3, 4)])
    assert {r.node: r.paths for r in X.shortest_path_counts(two, 0).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    assert len(X.all_simple_paths(two, 0, 4).collect()) == 2 and X.all_simple_paths(two, 0, 4, 2).count() == 0
    assert X.bidirectional_bfs(two, 0, 4).first().distance == 3 and X.bidirectional_bfs(g, 3, 4).first().distance is None
    assert [(r.node, r.parent) for r in X.depth_first(two, 0).orderBy("position").collect()] == [(0, None), (1, 0), (3, 1), (2, 3), (4, 3)]
    labels = X.Labels(two)
    exact = {(r.source, r.node): r.distance for r in D.distances(two).collect()}
    assert all(labels.distance(a, b) == exact[a, b] for a in range(5) for b in range(5))
    labels.insert(0, 4)
    assert labels.distance(0, 4) == 1 and labels.distance(2, 4) == 2


def test_distance_measures(spark, t6):
    assert [(r.lower, r.upper) for r in X.diameter_range(t6).collect()] == [(3, 3)]
    low, up = X.diameter_range(graph(spark, [(i, i + 1) for i in range(40)]), 0.5).first()
    assert low <= 40 <= up <= 1.5 * low
    assert X.effective_diameter(t6, 1.0).first()[0] == pytest.approx(np.mean([3, 3, 2, 2, 2, 3]))
    ring = graph(spark, [(i, (i + 1) % 60) for i in range(60)])
    approx = {r.distance: r.pairs for r in X.approximate_neighbourhood_function(ring, rounds=6).collect()}
    assert all(abs(approx[h] - 60 * (2 * h + 1)) <= 0.3 * 60 * (2 * h + 1) for h in range(1, 6))
    assert X.hop_plot(ring, rounds=40).agg(F.max("share")).first()[0] == 1.0
    assert abs(X.approximate_effective_diameter(ring).first()[0] - 27) <= 9
    some = {r.distance: r.pairs for r in X.sampled_neighbourhood_function(ring, 10).collect()}
    assert some[1] == pytest.approx(120)
    loads = X.algebraic_loads(t6, 3, 5)
    assert all(0 <= x <= 1 for r in loads.collect() for x in r.x)
    assert X.algebraic_distance(graph(spark, ring_of_cliques(2, 5)), rounds=60).where("abs(u - v) < 5").agg(F.avg("distance")).first()[0] < 0.5


def test_dynamic_updates(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 4), (5, 6)], 8)
    watched = U.Watched(g)
    comp, dist = U.dynamic_components(watched), U.dynamic_distances(watched, 0)
    with pytest.raises(RuntimeError):
        _ = comp.result
    comp.run(), dist.run()
    ev = lambda rows: spark.createDataFrame(rows, "seq long, type string, u long, v long, w double")
    for batch in (
        [(0, "EDGE_ADDITION", 2, 3, 1.0), (1, "EDGE_ADDITION", 7, 6, 2.0)],
        [(0, "EDGE_REMOVAL", 0, 1, None), (1, "NODE_ADDITION", 9, None, None)],
        [(0, "EDGE_WEIGHT_UPDATE", 1, 2, 0.5), (1, "EDGE_ADDITION", 0, 4, 1.0), (2, "TIME_STEP", None, None, None)],
    ):
        watched.apply(ev(batch))
        assert pairs(comp.result, "node", "component") == pairs(I.connected_components(watched.graph), "node", "component")
        assert pairs(dist.result, "node", "distance") == pairs(I.shortest_paths(watched.graph, spark.createDataFrame([(0,)], "id long")), "node", "distance")
    back = U.difference(g, watched.graph)
    assert pairs(U.updated(g, back).edges, "src", "dst", "weight") == pairs(watched.graph.edges, "src", "dst", "weight")
    steps = ev([(0, "NODE_ADDITION", 8, None, None), (1, "TIME_STEP", None, None, None), (2, "EDGE_ADDITION", 8, 0, 1.0), (3, "EDGE_REMOVAL", 0, 1, None), (4, "EDGE_ADDITION", 7, 0, 1.0), (5, "TIME_STEP", None, None, None)])
    assert [(r.nodes, r.edges) for r in U.timeline(g, steps).orderBy("step").collect()] == [(8, 4), (9, 4), (9, 5)]
    rows = X.apsp(g)
    new = graph(spark, [(0, 1), (1, 2), (3, 4), (5, 6), (2, 3)], 8)
    assert pairs(X.relaxed_pairs(rows, 2, 3, 1.0), "source", "target", "distance") == pairs(X.apsp(new), "source", "target", "distance")
    before, after = (I.bfs(x, spark.createDataFrame([(0,)], "id long")) for x in (g, new))
    assert pairs(X.affected_nodes(before, after), "node") == {(3,), (4,)}
    with pytest.raises(ValueError):
        U.updated(g, ev([(0, "NODE_REMOVAL", 0, None, None)]))


def test_event_stream(spark, tmp_path):
    g = graph(spark, [(0, 1)], 4)
    watched = U.Watched(g)
    spark.createDataFrame([(0, "EDGE_ADDITION", 1, 2, 1.0), (1, "EDGE_REMOVAL", 0, 1, None)], "seq long, type string, u long, v long, w double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, type string, u long, v long, w double").parquet(str(tmp_path / "in"))
    query = U.run_stream(stream, watched, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert pairs(watched.graph.edges, "src", "dst") == {(2, 1)}


def test_parts_and_order(spark):
    bow = graph(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 2), (4, 5)])
    parts = {}
    for r in K.biconnected_components(bow).collect():
        parts.setdefault(r.component, set()).add(r.node)
    assert {frozenset(p) for p in parts.values()} == {frozenset({0, 1, 2}), frozenset({2, 3, 4}), frozenset({4, 5})}
    with pytest.raises(ValueError):
        T.topological_order(graph(spark, [(0, 1), (1, 0)], directed=True)).collect()
    assert not T.is_bipartite(bow).first().bipartite
    rng = np.random.default_rng(2)
    e = {(int(a), int(b)) for a, b in rng.integers(0, 25, (45, 2)) if a != b}
    reach = np.eye(25, dtype=bool)
    for a, b in e:
        reach[a, b] = True
    for k in range(25):
        reach |= reach[:, k, None] & reach[None, k, :]
    want = {(v, int(np.flatnonzero(reach[v] & reach[:, v])[0])) for v in range(25)}
    assert pairs(I.strongly_connected_components(graph(spark, sorted(e), 25, True)), "node", "component") == want
    chain = graph(spark, [(i, i + 1) for i in range(30)], directed=True)
    assert pairs(I.strongly_connected_components(chain), "node", "component") == {(i, i) for i in range(31)}
    assert {r.path: 1 for r in X.all_simple_paths(bow, 0, 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "").alias("path")).collect()} == {"0245": 1, "01245": 1, "02345": 1, "012345": 1}


def test_edits(spark):
    g = graph(spark, [(0, 1, 2), (2, 3, 5)], 5)
    s = T.swap_edges(g, spark.createDataFrame([(0, 1, 2, 3)], "s1 long, t1 long, s2 long, t2 long"))
    assert pairs(s.edges, "src", "dst", "weight") == {(3, 0, 2.0), (2, 1, 5.0)}
    c = T.from_csr(spark, [1, 0, 2, 1], [0, 1, 3, 4])
    assert pairs(c.edges, "src", "dst") == {(1, 0), (2, 1)} and c.vertices.count() == 3
    with pytest.raises(ValueError):
        T.from_csr(spark, [5], [0, 1])
    ids = T.continuous_ids(g, seed=3)
    assert sorted(r.number for r in ids.collect()) == list(range(5))
    assert pairs(T.restored(T.remapped(g, ids), ids).edges, "src", "dst", "weight") == pairs(g.edges, "src", "dst", "weight")
    h = T.with_edge_attribute(g, "kind", spark.createDataFrame([(1, 0, "x")], "src long, dst long, value string"))
    assert ("edge", "kind", "string") in T.attributes(h) and T.attributes(T.without_attribute(h, "kind")) == []
    assert T.random_nodes(g, 3).count() == 3 and T.random_edges(g, 1).count() == 1 and T.random_neighbours(g).count() == 4
    assert 0 < T.randomized_weights(g).edges.first().weight < 1 and T.nodes_in_random_order(g).count() == 5
    assert [r.weight for r in T.sorted_edges(g, True).collect()] == [5.0, 2.0]


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(5)
    e = [(int(a), int(b), float(rng.integers(1, 6))) for a in range(9) for b in range(a) if rng.random() < 0.6]
    g = graph(spark, e, 9)
    near = {v: set() for v in range(9)}
    for a, b, _ in e:
        near[a].add(b)
        near[b].add(a)
    quad = {(a, b): sum(1 for x in near[a] - {b} for y in near[b] - {a} if x != y and y in near[x]) for a, b, _ in e}
    assert {(r.src, r.dst): r.score for r in E.quadrangles(g).collect()} == quad
    w = {(a, b): x for a, b, x in e}
    rank = {u: {v: sum(w[max(u, y), min(u, y)] > w[max(u, v), min(u, v)] for y in near[u]) for v in near[u]} for u in near}

    def prefix(a, b):
        best = 0.0
        for r in range(9):
            x, y = ({v for v, k in rank[i].items() if k <= r and v != j} for i, j in ((a, b), (b, a)))
            best = max(best, len(x & y) / len(x | y) if x | y else 0.0)
        return best

    got = {(r.src, r.dst): r.score for r in E.prefix_jaccard(g.edges.withColumnRenamed("weight", "score")).collect()}
    assert got == pytest.approx({(a, b): prefix(a, b) for a, b, _ in e})
    burnt = E.forest_fire(g, 0.5, 3.0)
    assert burnt.count() == len(e) and burnt.agg(F.max("score")).first()[0] == 1.0
    for f in (lambda x: E.random_part(g, x), lambda x: E.random_node_edge_part(g, x)):
        assert f(0.0).edges.count() <= f(0.5).edges.count() <= f(1.0).edges.count() == len(e)
    keep = E.parameter_for_ratio(g, E.by_local_degree, 0.5)
    assert abs(E.by_local_degree(g, keep).edges.count() / len(e) - 0.5) <= 0.35
    assert E.parameter_by_search(g, lambda h, v: E.random_part(h, v), 0.9, [0.1, 0.9]) == 0.9
    for h in (E.by_scan(g, 0.1), E.by_local_similarity(g, 0.1), E.disparity(g, 0.1), E.triangle_disparity(g, 0.1), E.simmelian_nonparametric(g, 0.1), E.simmelian_parametric(g, 3, 1), E.by_forest_fire(g, 0.1)):
        assert h.vertices.count() == 9 and h.edges.count() <= len(e)


def test_prediction(spark, t6):
    q = t6.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    d = {v: sum(v in x for x in T6) for v in range(6)}
    near = {v: {a + b - v for a, b in T6 if v in (a, b)} for v in range(6)}
    for flag in (False, True):
        got = {(r.u, r.v): r.score for r in L.adjusted_rand_index(t6, q, flag).collect()}
        for u, v in got:
            a, union = len(near[u] & near[v]), len(near[u] | near[v])
            b, c = (d[u] - a, d[v] - a) if flag else (union, union)
            rest = 6 - a - b - c
            below = (a + b) * (b + rest) + (a + c) * (c + rest)
            assert got[u, v] == pytest.approx(2 * (a * rest - b * c) / below if below else 0.0)
    assert pairs(L.missing_links(t6, 3), "u", "v") == {(0, 5), (1, 5)}
    train = L.training_graph(t6, count=4)
    assert train.edges.count() == 4 and train.vertices.count() == 6
    with pytest.raises(ValueError):
        L.links_by_count(q.withColumn("score", F.lit(1.0)), 99)
    every = spark.createDataFrame([(a, b) for a in range(6) for b in range(a)], "u long, v long")
    model = L.trained_classifier(t6, t6, every)
    assert model.transform(L.pair_features(t6, every)).count() == 15
    curve = L.roc_curve(t6, every.withColumn("score", F.col("u") + 0.0), 5)
    assert 0 <= L.area(curve, "fpr", "tpr").first()[0] <= 1
    assert L.same_community(t6, q).count() == 6 and L.algebraic_index(t6, q, 2, 3).count() == 6


def test_matchings_sets_flow_planarity_and_cliques(spark):
    g = graph(spark, [(0, 1, 3), (1, 2, 4), (2, 3, 3), (3, 0, 1), (0, 2, 2)])
    assert pairs(B.b_matching(g), "src", "dst") == pairs(I.greedy_matching(g), "src", "dst")
    two = B.b_matching(g, 2)
    assert B.matching_report(g, two, 2).first().proper and two.agg(F.sum("weight")).first()[0] >= 10
    assert B.path_growing(g).agg(F.sum("weight")).first()[0] >= 6 / 2
    h = graph(spark, [(0, 1, 3), (1, 2, 4), (4, 5, 2), (5, 6, 1)], 7)
    assert pairs(B.updated_b_matching(h, B.b_matching(graph(spark, [(0, 1, 3), (4, 5, 2), (5, 6, 1)], 7)), spark.createDataFrame([(1, 2)], "src long, dst long")), "src", "dst") == pairs(B.b_matching(h), "src", "dst")
    s = B.independent_set(h)
    assert B.is_independent(h, s).first().independent
    chosen = {r.node for r in s.collect()}
    near = {v: {a + b - v for a, b in ((0, 1), (1, 2), (4, 5), (5, 6)) if v in (a, b)} for v in range(7)}
    assert all(v in chosen or near[v] & chosen for v in range(7))
    net = graph(spark, [(0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 4)], directed=True)
    value, flow, side = B.maximum_flow(net, 0, 3)
    assert value == 5 and flow.where("src = 0").agg(F.sum("flow")).first()[0] == 5 and pairs(side, "node") >= {(0,)}
    assert B.maximum_flow(graph(spark, [(0, 1, 3), (1, 2, 2)]), 0, 2)[0] == 2
    k = lambda n: [(i, j) for i in range(n) for j in range(i)]
    three = [(i, j) for i in range(3) for j in range(3, 6)]
    grid = [(i * 4 + j, i * 4 + j + 1) for i in range(4) for j in range(3)] + [(i * 4 + j, i * 4 + j + 4) for i in range(3) for j in range(4)]
    for e, planar in ((k(4), True), (k(5), False), (three, False), (grid, True), (k(5)[:-1], True), ([*three, (0, 6), (6, 1)][1:], True), (ring_of_cliques(3, 4), True), (ring_of_cliques(3, 5), False)):
        assert B.is_planar(graph(spark, e)).first().planar == planar
    c = B.maximal_cliques(graph(spark, [(0, 1), (0, 2), (1, 2), (2, 3)], 5))
    assert {tuple(r.clique) for r in c.collect()} == {(0, 1, 2), (2, 3), (4,)}
    assert B.maximal_cliques(graph(spark, [(0, 1), (0, 2), (1, 2), (2, 3)]), True).first().clique == [0, 1, 2]
    u = B.union_maximum_forest(graph(spark, [(0, 1, 2), (1, 2, 2), (0, 2, 2), (2, 3, 1), (0, 3, 1), (3, 4, 5)]))
    assert pairs(u, "src", "dst") == {(1, 0), (2, 1), (2, 0), (3, 2), (3, 0), (4, 3)}


def test_local_communities(spark, cliques):
    seeds = spark.createDataFrame([(2,), (13,)], "id long")
    for kernel in (S.greedy(), S.fitness(), S.clique_around(), S.triangles_first(), S.nibble(0.1, 1e-7), S.border_sharpness(), S.two_phases()):
        found = {}
        for r in S.detected(cliques, seeds, kernel).collect():
            found.setdefault(r.seed, set()).add(r.node)
        assert found[2] >= set(range(5)) and found[13] >= set(range(10, 15))
    truth = spark.createDataFrame([(i, i // 5) for i in range(30)], "node long, community long")
    t = S.compared_to_truth(S.detected(cliques, seeds, S.clique_around()), truth).collect()
    assert all(r.f1 == r.jaccard == r.precision == r.recall == 1.0 for r in t)
    mass = S.approximate_pagerank(cliques, seeds, 0.1, 1e-7).groupBy("seed").agg(F.sum("score").alias("s")).collect()
    assert all(0.9 < r.s <= 1.0 for r in mass)
    assert S.overlapping_by_fitness(cliques).select("node").distinct().count() == 30
    base = S.detected(cliques, seeds, S.breadth_first_set(5)).count()
    assert base == 10 and S.detected(cliques, seeds, S.combined(S.clique_around(), then=S.clique_around())).count() >= 10


def test_covers_and_measures(spark):
    p = spark.createDataFrame([(i, i // 3) for i in range(9)], "node long, community long")
    assert P.overlapping_nmi(p, p).first()[0] == pytest.approx(0) and P.adjusted_rand(p, p).first()[0] == pytest.approx(0)
    q = spark.createDataFrame([(i, i % 3) for i in range(9)], "node long, community long")
    for kind in ("min", "max", "arithmetic", "geometric", "joint"):
        assert 0.5 < P.overlapping_nmi(p, q, kind).first()[0] <= 1.0001
    assert P.dynamic_nmi(p, p).first()[0] == pytest.approx(0) and P.sampled_rand(p, p, 100).first()[0] == 0
    cover = P.added_to(p, spark.createDataFrame([(0, 2)], "node long, community long"))
    assert cover.count() == 10 and P.removed_from(cover, p).count() == 1 and P.moved_to(cover, spark.createDataFrame([(0, 5)], "node long, community long")).where("node = 0").count() == 1


def test_randomization_and_walks(spark, t6):
    for h in (R.edge_switching(t6, 20.0), R.curveball(t6, R.uniform_trades(20, 6)), R.global_curveball(t6, 5, shuffle=False)):
        assert pairs(T.weighted_degrees(T.unweighted(h)), "node", "weighted_degree") == pairs(T.weighted_degrees(t6), "node", "weighted_degree")
        assert T.parallel_edges(h).count() == 0 and h.edges.where("src = dst").count() == 0
    arcs = {(a, b) for a, b in T6} | {(b, a) for a, b in T6}
    for r in R.biased_walks(t6, 0.5, 2.0, 6, 2).collect():
        assert all((int(a), int(b)) in arcs for a, b in itertools.pairwise(r.walk))
    last = R.seir(t6, 8, 1.0, 1, 1, 2).where("step = 7 AND state = 'R'").first()
    assert last.nodes >= 5


def test_dense_operators_and_limits(spark, t6, monkeypatch):
    value = A.eigenvectors(t6, 2).where("rank = 1").first().value
    lap = np.diag([1, 1, 4, 2, 2, 2]) - np.array([[1.0 if (a, b) in T6 or (b, a) in T6 else 0.0 for b in range(6)] for a in range(6)])
    assert value == pytest.approx(np.linalg.eigvalsh(lap)[1])
    colour = {r.node: r.colour for r in A.spectral_colouring(t6).collect()}
    assert all(colour[a] != colour[b] for a, b in T6)
    assert A.pivot_layout(t6).count() == 6
    from graphloom.kernels import csr

    monkeypatch.setattr(csr, "MAX_EDGES", 3)
    with pytest.raises(TooLarge):
        collect(t6)


def test_formats(spark, tmp_path):
    from graphloom.sources import files
    from graphloom.sources import formats as Z

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    g = Z.read_konect(spark, put("k", "% asym posweighted\n% 3 4 4\n1 2 2\n1 2 5\n3 4 1\n"))
    assert g.directed and pairs(g.edges, "src", "dst", "weight") == {(0, 1, 2.0), (2, 3, 1.0)} and g.vertices.count() == 4
    with pytest.raises(ValueError):
        Z.read_konect(spark, put("kd", "% asym dynamic\n1 2 1 5\n"))
    m = Z.read_mtx_graph(spark, put("m", "%%MatrixMarket matrix coordinate pattern symmetric\n% c\n3 3 2\n2 1\n3 3\n"))
    assert not m.directed and pairs(m.edges, "src", "dst") == {(1, 0), (2, 2)}
    gml = Z.read_gml(spark, put("g.gml", 'graph [ directed 1 node [ id 1 label "a b" ] node [ id 2 ] edge [ source 1 target 2 weight 3.5 ] ]'))
    assert gml.directed and pairs(gml.edges, "src", "dst", "weight") == {(1, 2, 3.5)}
    xml = '<graphml><key id="d0" for="edge" attr.name="weight"/><graph edgedefault="undirected"><node id="x"/><node id="y"/><edge source="x" target="y"><data key="d0">2</data></edge></graph></graphml>'
    h, names = Z.read_graphml(spark, put("g.graphml", xml))
    assert pairs(h.edges, "src", "dst", "weight") == {(1, 0, 2.0)} and pairs(names, "name", "id") == {("x", 0), ("y", 1)}
    gexf = '<gexf><graph defaultedgetype="directed" mode="dynamic"><nodes><node id="0" start="1"/><node id="1" start="1" end="4"/></nodes><edges><edge source="0" target="1" start="2" end="3"/></edges></graph></gexf>'
    k, _, events = Z.read_gexf(spark, put("g.gexf", gexf))
    assert k.directed and [r.type for r in events.orderBy("seq").collect()] == ["NODE_ADDITION", "NODE_ADDITION", "TIME_STEP", "EDGE_ADDITION", "TIME_STEP", "EDGE_REMOVAL", "TIME_STEP", "NODE_REMOVAL"]
    dgs = 'DGS004\nx 0 0\nan "a"\nan "b"\nae "ab" "a" "b" weight=2\nst 1\nce a-b weight=5\nde a-b\n'
    ev, who = Z.read_dgs(spark, put("d", dgs))
    assert [(r.type, r.u, r.v, r.w) for r in ev.orderBy("seq").collect()] == [("NODE_ADDITION", 0, None, None), ("NODE_ADDITION", 1, None, None), ("EDGE_ADDITION", 0, 1, 2.0), ("TIME_STEP", None, None, None), ("EDGE_WEIGHT_UPDATE", 0, 1, 5.0), ("EDGE_REMOVAL", 0, 1, None)]
    assert pairs(who, "name", "id") == {("a", 0), ("b", 1)}
    e, ids = files.read_named_edge_list(spark, put("n", "# c\nx y 2\ny z\nx y 9\n"))
    assert pairs(e.edges, "src", "dst", "weight") == {(1, 0, 2.0), (2, 1, 1.0)} and pairs(ids, "name", "id") == {("x", 0), ("y", 1), ("z", 2)}
    s, out = Z.read_snap_remapped(spark, put("s", "# c\n70 5\n5 9\n"))
    assert pairs(s.edges, "src", "dst") == {(1, 0), (2, 1)} and pairs(out, "id", "number") == {(70, 0), (5, 1), (9, 2)}
    assert pairs(Z.read_cover_list(spark, put("c", "1 4 5\n2 5\n")), "node", "community") == {(0, 4), (0, 5), (1, 5)}
    assert pairs(Z.read_partition_list(spark, put("p", "1\t7\n2\t8\n")), "node", "community") == {(0, 7), (1, 8)}
    p = spark.createDataFrame([(0, 3), (2, 1)], "node long, community long")
    for width, both in ((4, False), (8, True)):
        (tmp_path / f"b{width}").write_bytes(Z.binary_partition(p, width, both))
        assert pairs(Z.read_binary_partition(spark, str(tmp_path / f"b{width}"), width, both), "node", "community") == {(0, 3), (2, 1)}
    for kind in ("edgelist", "snap", "dot", "gml", "graphml", "gexf", "metis"):
        Z.write_graph(m, str(tmp_path / f"w-{kind}"), kind)
    assert "0" in Z.read_lines(spark, str(tmp_path / "w-dot")).agg(F.concat_ws(" ", F.collect_list("value")).alias("t")).first().t
    assert Z.read_graph(spark, put("auto", "% sym unweighted\n1 2\n")).edges.count() == 1 and len(Z.read_graphs(spark, [str(tmp_path / "auto")])) == 1
    Z.convert_graph(spark, str(tmp_path / "auto"), str(tmp_path / "conv"), "edgelist")
    assert files.read_edge_list(spark, str(tmp_path / "conv")).edges.count() == 1


def test_numbers_over_partitions(spark):
    from graphloom.plans.numbering import numbered

    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    got = numbered(df, "x", name="k").collect()
    assert all(r.x == r.k for r in got) and len(got) == 5000
