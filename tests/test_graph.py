"""Golden values on small graphs, and properties of operators that SQL can't express."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import algebra as A
from graphloom.operators import distances as X
from graphloom.operators import iterative as I
from graphloom.operators import partitions as P
from graphloom.operators import similarity as L
from graphloom.operators import structure as D
from graphloom.operators import triangles as T
from graphloom.sources import files
from graphloom.streaming import events as E

W8 = [(0, 2, 3.0), (1, 2, 2.0), (2, 3, 3.0), (2, 4, 2.0), (2, 5, 1.5), (3, 5, 3.0), (4, 5, 2.0), (5, 6, 3.0), (5, 7, 2.0)]
G6 = [(0, 1), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5), (3, 5)]


def graph(spark, edges, directed=False, n=None, **kw):
    rows = [(*e, 1.0) if len(e) == 2 else e for e in edges]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    return Graph.from_edges(df, directed, spark.range(n) if n else None, **kw)


def values(df, key="node", value="score"):
    return {r[key]: r[value] for r in df.collect()}


def test_pagerank_and_eigenvector_golden(spark):
    g = graph(spark, W8, n=8)
    want = [0.0753, 0.0565, 0.2552, 0.1319, 0.0942, 0.2552, 0.0753, 0.0565]
    got = values(I.pagerank(g))
    assert [got[i] for i in range(8)] == pytest.approx(want, abs=1e-4)
    want = [0.2254, 0.1503, 0.5290, 0.4508, 0.3006, 0.5290, 0.2254, 0.1503]
    got = values(I.eigenvector(g))
    assert [abs(got[i]) for i in range(8)] == pytest.approx(want, abs=1e-3)


def test_global_clustering_golden(spark):
    assert T.global_clustering(graph(spark, G6, n=6)).first()["transitivity"] == pytest.approx(18 / 34)


def test_pagerank_with_sinks_sums_to_one(spark):
    g = graph(spark, [(0, 1), (1, 0), (0, 2), (1, 2)], directed=True, n=5)
    got = values(I.pagerank(g, distribute_sinks=True))
    assert sum(got.values()) == pytest.approx(1)
    assert got[0] / got[3] == pytest.approx(1.7391, abs=1e-3) and got[2] / got[3] == pytest.approx(2.4781, abs=1e-3)


def test_empty_graph(spark):
    g = graph(spark, [])
    assert D.degrees(g).count() == T.triangles(g).count() == I.connected_components(g).count() == I.pagerank(g).count() == I.greedy_matching(g).count() == 0


def test_loops_and_parallel_edges(spark):
    g = graph(spark, [(1, 1, 2.0), (1, 2, 1.0), (2, 1, 3.0)], multi="sum")
    assert {(r.src, r.dst, r.weight) for r in g.edges.collect()} == {(1, 1, 2.0), (2, 1, 4.0)}
    assert values(D.degrees(g), value="degree") == {1: 2, 2: 1}
    assert D.size(g).first()["self_loops"] == 1


def test_components_cores_and_paths(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], n=8)
    assert values(I.connected_components(g), value="component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    assert values(I.core_numbers(g), value="core") == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0, 5: 1, 6: 1, 7: 0}
    b = {r.node: (r.distance, r.paths) for r in I.bfs(graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3)]), spark.range(1)).collect()}
    assert b == {0: (0, 1.0), 1: (1, 1.0), 2: (1, 1.0), 3: (2, 2.0)}
    s = values(I.shortest_paths(graph(spark, [(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0)]), spark.range(1)), value="distance")
    assert s == {0: 0.0, 1: 2.0, 2: 1.0}


def test_strong_components(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0)], directed=True)
    assert values(I.strongly_connected_components(g), value="component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_forest_and_matching(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (3, 4, 5.0), (2, 3, 4.0)])
    f = I.spanning_forest(g)
    assert f.count() == 4 and f.agg(F.sum("weight")).first()[0] == 12.0
    assert {(r.src, r.dst) for r in I.greedy_matching(g).collect()} == {(4, 3), (2, 0)}


def test_label_propagation_finds_cliques(spark):
    a = [(i, j) for i in range(5) for j in range(i)]
    b = [(i + 5, j + 5) for i, j in a]
    got = values(I.label_propagation(graph(spark, [*a, *b, (4, 5)])), value="community")
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1


def test_partition_and_similarity(spark):
    g = graph(spark, G6, n=6)
    p = spark.createDataFrame([(i, int(i > 2)) for i in range(6)], "node long, community long")
    assert P.compared(p, p).first().asDict() == pytest.approx({"rand": 0, "jaccard": 0, "nmi_distance": 0})
    c = {(r.u, r.v): (r.common, r.adamic_adar) for r in L.common_neighbours(g).collect()}
    assert c[(0, 2)] == (1, pytest.approx(1 / math.log(4)))


def test_algebra(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "i long, j long, v double")
    assert {(r.i, r.j): r.v for r in A.mxm(m, m).collect()} == {(0, 0): 1.0, (0, 1): 8.0, (1, 1): 9.0}
    assert {(r.i, r.j): r.v for r in A.mxm(m, m, "min_plus").collect()} == {(0, 0): 2.0, (0, 1): 3.0, (1, 1): 6.0}


def test_files(spark, tmp_path):
    (tmp_path / "g.metis").write_text("% tiny\n3 2\n2\n1 3\n2\n")
    g = files.read_metis(spark, str(tmp_path / "g.metis"))
    assert {(r.src, r.dst) for r in g.edges.collect()} == {(1, 0), (2, 1)}
    assert {r.node: r.line for r in files.metis_rows(g).collect()} == {0: "2", 1: "1 3", 2: "2"}
    files.write_edge_list(g, str(tmp_path / "el"))
    again = files.read_edge_list(spark, str(tmp_path / "el"))
    assert {(r.src, r.dst, r.weight) for r in again.edges.collect()} == {(1, 0, 1.0), (2, 1, 1.0)}


def test_replay(spark):
    rows = [(1, "EDGE_ADDITION", 0, 1, 1.0), (2, "EDGE_WEIGHT_INCREMENT", 0, 1, 2.0), (3, "EDGE_ADDITION", 1, 2, 1.0), (4, "EDGE_REMOVAL", 1, 2, None), (5, "EDGE_WEIGHT_UPDATE", 0, 1, 7.0)]
    got = E.replay(spark.createDataFrame(rows, "seq long, type string, u long, v long, w double")).collect()
    assert [(r.u, r.v, r.w) for r in got] == [(0, 1, 7.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", 0, 1) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, u long, v long").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = E.edge_windows(stream, window="10 minutes").writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.window_start, r.n) for r in d.collect())
    assert key(spark.table("win")) == key(E.edge_windows(df, window="10 minutes"))


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


T6 = [(0, 2), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5)]


def test_betweenness_golden(spark):
    got = values(X.betweenness(graph(spark, T6, n=6)))
    assert [got[i] for i in range(6)] == pytest.approx([0, 0, 15, 3, 3, 1])
    got = values(X.betweenness(graph(spark, T6, n=6), normalized=True))
    assert [got[i] for i in range(6)] == pytest.approx([x / 20 for x in (0, 0, 15, 3, 3, 1)])
    got = values(X.betweenness(graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], directed=True)))
    assert got == {0: 1, 1: 2, 2: 3, 3: 0}  # 0-2, 0-3 by 1; 0-3, 1-0, 1-3 by 2; 2-1 by 0


def test_closeness_and_eccentricity(spark):
    g = graph(spark, T6, n=6)
    got = values(X.closeness(g))
    assert [got[i] for i in range(6)] == pytest.approx([0.1, 0.1, 1 / 6, 0.125, 0.125, 0.1])
    apart = graph(spark, [(0, 1), (1, 2), (4, 5)], n=7)
    assert values(X.closeness(apart, generalized=True)) == pytest.approx({0: 4 / 18, 1: 4 / 12, 2: 4 / 18, 3: 0, 4: 1 / 6, 5: 1 / 6, 6: 0})
    assert values(X.harmonic_closeness(apart, normalized=False)) == pytest.approx({0: 1.5, 1: 2, 2: 1.5, 3: 0, 4: 1, 5: 1, 6: 0})
    assert values(X.eccentricity(apart), value="eccentricity") == {0: 2, 1: 1, 2: 2, 3: 0, 4: 1, 5: 1, 6: 0}
    assert X.diameter(g).first().asDict() == {"diameter": 3, "radius": 2}
    assert values(X.distance_distribution(apart), "distance", "pairs") == {1: 6, 2: 2}
    assert X.betweenness(graph(spark, [])).count() == X.closeness(graph(spark, [])).count() == 0


@pytest.fixture
def whole_trade(spark, tmp_path):
    """Tables whose trade graph has 9 arcs, and those arcs: one order, customer and supplier per lineitem."""
    arcs = {(0, 1): 2, (1, 2): 1, (0, 2): 4, (2, 3): 1, (3, 0): 1, (3, 4): 2, (4, 5): 1, (5, 4): 3, (0, 5): 9}
    lines = [a for a, n in arcs.items() for _ in range(n)]
    k = range(len(lines))
    tables = {
        "lineitem": ("l_orderkey long, l_suppkey long", [(i, i) for i in k]), "orders": ("o_orderkey long, o_custkey long", [(i, i) for i in k]),
        "customer": ("c_custkey long, c_nationkey int", [(i, lines[i][0]) for i in k]), "supplier": ("s_suppkey long, s_nationkey int", [(i, lines[i][1]) for i in k]),
        "nation": ("n_nationkey int", [(i,) for i in range(7)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path), arcs


def test_paths_and_strong_components_of_all_trade(spark, whole_trade):
    import __spark_entry__ as e

    sf, arcs = whole_trade
    far = {(a, b): 0.0 if a == b else float(arcs.get((a, b), math.inf)) for a in range(7) for b in range(7)}
    for k in range(7):
        for a in range(7):
            for b in range(7):
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    got = values(e.queries()["distance_sssp_trade"](spark, sf), value="distance")
    assert got == {b: far[0, b] for b in range(7) if far[0, b] < math.inf}
    strong = {a: min(b for b in range(7) if far[a, b] < math.inf and far[b, a] < math.inf) for a in range(7)}
    assert values(e.queries()["components_strong_trade"](spark, sf), value="component") == strong


def test_path_measures_of_strong_co_purchases(spark, tmp_path):
    import __spark_entry__ as e

    edges = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (6, 7)]  # a cycle, so that shortest paths aren't unique
    rows = [(2 * k + r, p) for k, ends in enumerate([*edges, (5, 6)]) for r in range(2 if k < len(edges) else 1) for p in ends]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i,) for i in range(1, 9)], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    nodes = range(1, 9)
    far = {(a, b): 0 if a == b else 1 if (a, b) in edges or (b, a) in edges else math.inf for a in nodes for b in nodes}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    paths = {(a, a): 1 for a in nodes}
    for a, b in sorted(far, key=far.get):
        if 0 < far[a, b] < math.inf:
            paths[a, b] = sum(paths[a, c] for c in nodes if far[c, b] == 1 and far[a, c] + 1 == far[a, b])
    met = {a: [far[a, b] for b in nodes if b != a and far[a, b] < math.inf] for a in nodes}
    between = {c: sum(paths[a, c] * paths[c, b] / paths[a, b] for a in nodes for b in nodes if len({a, b, c}) == 3 and far[a, b] < math.inf and far[a, c] + far[c, b] == far[a, b]) for c in nodes}
    run = lambda name, value="score", key="node": values(e.queries()[name](spark, str(tmp_path)), key, value)
    assert run("components_connected_strong", "component") == {a: min(b for b in nodes if far[a, b] < math.inf) for a in nodes}
    assert run("centrality_betweenness_strong") == pytest.approx(between)
    assert run("centrality_closeness_strong") == pytest.approx({a: len(m) ** 2 / sum(m) / 7 if m else 0 for a, m in met.items()})
    assert run("centrality_harmonic_closeness_strong") == pytest.approx({a: sum(1 / x for x in m) / 7 for a, m in met.items()})
    assert run("distance_eccentricity_strong", "eccentricity") == {a: max(m, default=0) for a, m in met.items()}
    flat = [x for m in met.values() for x in m]
    assert run("distance_distribution_strong", "pairs", "distance") == {x: flat.count(x) for x in set(flat)}
    assert e.queries()["distance_diameter_strong"](spark, str(tmp_path)).first().asDict() == {"diameter": 3, "radius": 0}
