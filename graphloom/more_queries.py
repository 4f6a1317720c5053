"""Queries of generators, randomization, local communities, event streams and files. Generated graphs are judged by what must hold for each, which SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, co_purchase
from graphloom.graph_queries import CP, CP2, _simple
from graphloom.operators import generators as G
from graphloom.operators import local as S
from graphloom.operators import paths as X
from graphloom.operators import randomize as R
from graphloom.operators.structure import degrees
from graphloom.plans.scratch import materialize
from graphloom.plans.spread import spread
from graphloom.registry import query
from graphloom.streaming import kept as K
from graphloom.streaming import updates as U
from graphloom.tool_queries import _SMALL, PUR, SUP, purchases, small, supply


def _generated(name: str, make, sql: str | None, look=None) -> None:
    """look: what to show of the graph; by default its edges."""
    query(f"generate_{name}", sql)(lambda spark, sf, make=make, look=look: (look or (lambda g: g.edges))(make(spark)))


def _simple_size(g: Graph) -> DataFrame:
    """One row: nodes, and whether there are edges, no loops and no parallel ones."""
    e = g.edges.agg(F.count("*").alias("m"), F.count_distinct("src", "dst").alias("d"), F.count_if(F.expr("src = dst")).alias("loops"))
    n = g.vertices.count()
    return e.select(F.lit(n).cast("long").alias("nodes"), ((F.col("m") > 0) & (F.col("m") == F.col("d")) & (F.col("loops") == 0)).alias("simple"))


def _size_sql(n: int) -> str:
    return f"SELECT CAST({n} AS BIGINT) AS nodes, true AS simple"


_generated("ring_lattice", lambda s: G.ring_lattice(s, 500, 3), "SELECT greatest(i, (i + j) % 500) AS src, least(i, (i + j) % 500) AS dst, 1.0 AS weight FROM range(500) a(i), range(1, 4) b(j)")
_generated("erdos_renyi", lambda s: G.erdos_renyi(s, 2000, 0.005), _size_sql(2000), _simple_size)
_generated("erdos_renyi_directed", lambda s: G.erdos_renyi(s, 1000, 0.005, directed=True), _size_sql(1000), _simple_size)
_generated("block_model", lambda s: G.block_model(s, [i % 3 for i in range(600)], [[0.1, 0.01, 0.0], [0.01, 0.1, 0.0], [0.0, 0.0, 0.2]]), _size_sql(600), _simple_size)
_generated("clustered_random", lambda s: G.clustered_random(s, 600, 4, 0.2, 0.01)[0], _size_sql(600), _simple_size)
_generated("rmat", lambda s: G.rmat(s, 10, 8, 0.57, 0.19, 0.19, 0.05), _size_sql(1024), _simple_size)
_generated("watts_strogatz", lambda s: G.watts_strogatz(s, 1000, 4, 0.1), _size_sql(1000), _simple_size)
_generated("barabasi_albert", lambda s: G.barabasi_albert(s, 3, 1000), _size_sql(1000), _simple_size)
_generated("chung_lu", lambda s: G.chung_lu(s, [20] * 50 + [5] * 500), _size_sql(550), _simple_size)
_generated("chung_lu_by_classes", lambda s: G.chung_lu_by_classes(s, [20] * 50 + [5] * 500), _size_sql(550), _simple_size)
_DEGREES = [6] * 40 + [3] * 120
_HAVE = "SELECT i AS node, CASE WHEN i < 40 THEN 6 ELSE 3 END AS degree FROM range(160) t(i)"
_generated("havel_hakimi", lambda s: G.havel_hakimi(s, _DEGREES), _HAVE, lambda g: degrees(g).select("node", "degree"))
_generated("configuration_model", lambda s: G.configuration_model(s, _DEGREES), _HAVE, lambda g: degrees(g).select("node", "degree"))
_generated("dorogovtsev_mendes", lambda s: G.dorogovtsev_mendes(s, 300), "SELECT CAST(300 AS BIGINT) AS nodes, CAST(597 AS BIGINT) AS edges", lambda g: g.edges.agg(F.lit(300).cast("long").alias("nodes"), F.count("*").alias("edges")))
_generated("lfr", lambda s: G.lfr(s, 500)[0], _size_sql(500), _simple_size)
_generated("hyperbolic", lambda s: G.hyperbolic(s, 1000, 8), _size_sql(1000), _simple_size)
_generated("hyperbolic_warm", lambda s: G.hyperbolic(s, 500, 8, temperature=0.2), _size_sql(500), _simple_size)
_generated("pub_web", lambda s: G.pub_web(s, 400), _size_sql(400), _simple_size)
_generated("mocnik", lambda s: G.mocnik(s, 2, 400, 2.0), _size_sql(400), _simple_size)
_generated("mocnik_layers", lambda s: G.mocnik_layers(s, 2, [100, 200], [2.0, 1.5]), _size_sql(300), _simple_size)


def _events(name: str, make, sql: str | None) -> None:
    query(f"events_{name}", sql)(lambda spark, sf, make=make: U.event_counts(make(spark)))


_events("path", lambda s: G.path_events(s, 50), "SELECT 'NODE_ADDITION' AS type, 51 AS n UNION ALL SELECT 'EDGE_ADDITION', 50 UNION ALL SELECT 'TIME_STEP', 50")
_events("dorogovtsev_mendes", lambda s: G.dorogovtsev_mendes_events(s, 50), "SELECT 'NODE_ADDITION' AS type, 53 AS n UNION ALL SELECT 'EDGE_ADDITION', 103 UNION ALL SELECT 'TIME_STEP', 50")
_events("barabasi_albert", lambda s: G.barabasi_albert_events(s, 50, 2), "SELECT 'NODE_ADDITION' AS type, 51 AS n UNION ALL SELECT 'EDGE_ADDITION', 99 UNION ALL SELECT 'TIME_STEP', 50")
_events("forest_fire", lambda s: G.forest_fire_events(s, 50), None)
_events("hyperbolic", lambda s: G.hyperbolic_events(s, 100, 6, 5), None)
_events("pub_web", lambda s: G.pub_web_events(s, 100, 5), None)

# randomization keeps degrees
_DEG = " SELECT node, degree FROM d"
_simple("randomize_edge_switching", purchases, lambda g: degrees(R.edge_switching(g, 2.0)).select("node", "degree"), PUR + _DEG)
_simple("randomize_curveball", purchases, lambda g: degrees(R.global_curveball(g, 3, shuffle=False)).select("node", "degree"), PUR + _DEG)
_simple("randomize_degree_preserving_shuffle", purchases, lambda g: degrees(R.degree_preserving_shuffle(g)).select("node", "degree"), PUR + _DEG)
_simple("components_random_spanning_forest", purchases, lambda g: X.random_spanning_forest(g).agg(F.count("*").alias("edges")), PUR + ", r AS (SELECT count(*) AS n FROM d WHERE degree > 0) SELECT n - 1 AS edges FROM r")
_simple("simulation_seir", purchases, lambda g: R.seir(g, 6, 0.3, 1, 2, 10**12).groupBy("step").agg(F.sum("nodes").alias("nodes")), PUR + " SELECT CAST(i AS INTEGER) AS step, CAST((SELECT count(*) FROM v) AS BIGINT) AS nodes FROM range(6) t(i)")
_simple("embedding_node2vec", supply, lambda g: R.node2vec(g, length=10, walks=2, dim=8).select("node", F.size("features").alias("dim")), SUP + " SELECT id AS node, 8 AS dim FROM v")

# local communities, seeds being the suppliers numbered 0 to 4
_SEEDED = SUP + " SELECT id AS seed, true AS holds FROM v WHERE id < 5"


def _local(name: str, kernel) -> None:
    def run(g: Graph) -> DataFrame:
        found = S.detected(g, g.vertices.where("id < 5"), kernel)
        return found.groupBy("seed").agg(F.max(F.col("node") == F.col("seed")).alias("holds"))

    _simple(f"local_{name}", supply, run, _SEEDED)


for _name, _kernel in {
    "greedy": S.greedy("M"), "greedy_by_border": S.greedy("L"), "fitness": S.fitness(), "border_sharpness": S.border_sharpness(), "tightness": S.tightness(), "triangles": S.triangles_first(refine=True),
    "two_phases": S.two_phases(), "clique": S.clique_around(), "nibble": S.nibble(), "breadth_first": S.breadth_first_set(10), "combined": S.combined(S.nibble(), S.expanded()),
}.items():
    _local(_name, _kernel)
_simple("local_pagerank", supply, lambda g: S.approximate_pagerank(g, g.vertices.where("id < 5")), None)
query("local_set_conductance", CP + f", m AS ({_SMALL}), c AS (SELECT sum(weight) FILTER ((src IN (SELECT id FROM m)) <> (dst IN (SELECT id FROM m))) AS cut, 2 * sum(weight) AS t FROM e), x AS (SELECT sum(wd) AS vol FROM d WHERE node IN (SELECT id FROM m)) SELECT cut / least(vol, t - vol) AS conductance FROM c, x")(lambda spark, sf: S.set_conductance(co_purchase(spark, sf), small(spark, sf)))

# streams


def _stream(spark, sf_dir) -> DataFrame:
    """Every lineitem adds or updates the edge from its supplier to its part; returned items take it away."""
    from graphloom.plans.numbering import numbered

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000000).alias("v"), "l_returnflag", "l_quantity")
    n = numbered(li, "l_orderkey", "l_linenumber", "u", "v", name="seq")
    kind = F.when(F.col("l_returnflag") == "R", "EDGE_REMOVAL").when(F.col("l_returnflag") == "A", "EDGE_WEIGHT_UPDATE").otherwise("EDGE_WEIGHT_INCREMENT")
    return n.select("seq", kind.alias("type"), "u", "v", F.col("l_quantity").alias("w"))


_STATE = (
    "WITH x AS (SELECT l_suppkey AS u, l_partkey + 1000000000 AS v, l_returnflag AS f, l_quantity AS w, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS seq FROM lineitem),"
    " h AS (SELECT *, max(CASE WHEN f IN ('A', 'R') THEN seq END) OVER (PARTITION BY u, v) AS last FROM x),"
    " k AS (SELECT u, v, sum(CASE WHEN f = 'R' THEN 0 ELSE w END) AS w, max(CASE WHEN seq = last THEN f END) AS t, count(*) FILTER (f NOT IN ('A', 'R')) AS more FROM h WHERE last IS NULL OR seq >= last GROUP BY u, v)"
)


@query("dynamics_all_events", _STATE + " SELECT u, v, w FROM k WHERE t IS NULL OR t <> 'R' OR more > 0")
def dynamics_all_events(spark, sf_dir) -> DataFrame:
    from graphloom.streaming.events import replay

    return replay(_stream(spark, sf_dir))


@query("dynamics_updated_graph", _STATE + ", e AS (SELECT * FROM k WHERE t IS NULL OR t <> 'R' OR more > 0) SELECT (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS nodes, count(*) AS edges, sum(w) AS weight FROM e")
def dynamics_updated_graph(spark, sf_dir) -> DataFrame:
    g = U.graph_from_events(_stream(spark, sf_dir), directed=True)
    return g.edges.agg(F.lit(g.vertices.count()).cast("long").alias("nodes"), F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query("dynamics_difference", SUP + " SELECT CASE WHEN weight < 10 THEN 'EDGE_REMOVAL' ELSE 'EDGE_WEIGHT_UPDATE' END AS type, count(*) AS n FROM e GROUP BY 1")
def dynamics_difference(spark, sf_dir) -> DataFrame:
    g = supply(spark, sf_dir).materialized()
    h = Graph(g.vertices, g.edges.where("weight >= 10").select("src", "dst", (F.col("weight") + 1).alias("weight")))
    return U.event_counts(U.difference(g, h))


@query("dynamics_components", None)
def dynamics_components(spark, sf_dir) -> DataFrame:
    """Components of purchases after all edges of a single lineitem went, kept up from those before."""
    g = purchases(spark, sf_dir).materialized()
    watched = U.Watched(g)
    kept = U.dynamic_components(watched).run()
    gone = g.edges.where("weight = 1").select(F.monotonically_increasing_id().alias("seq"), F.lit("EDGE_REMOVAL").alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(None).cast("double").alias("w"))
    watched.apply(gone)
    return kept.result


@query("dynamics_distances")
def dynamics_distances(spark, sf_dir) -> DataFrame:
    g = supply(spark, sf_dir).materialized()
    watched = U.Watched(g)
    d = U.dynamic_distances(watched, 0).run()
    watched.apply(spark.createDataFrame([(0, "EDGE_ADDITION", 0, 1, 0.5)], "seq long, type string, u long, v long, w double"))
    return d.result


# Strong co-purchases without the last week's orders; then these come, then those of the first week are cancelled.
_WEEKS = CP2.replace("FROM lineitem a JOIN lineitem b", "FROM lineitem a JOIN orders ON o_orderkey = a.l_orderkey AND o_orderdate >= (SELECT min(o_orderdate) FROM orders) + INTERVAL 7 DAY JOIN lineitem b")
_PATHS = _WEEKS + """, w(a, b, k, p) USING KEY (a, b) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM v UNION (SELECT w.a, s.v, min(w.k + 1), sum(w.p) FROM w JOIN s ON s.u = w.b
  LEFT JOIN recurring.w r ON r.a = w.a AND r.b = s.v WHERE r.a IS NULL GROUP BY w.a, s.v))"""


def _weeks(spark, sf_dir) -> tuple[U.Watched, list[DataFrame]]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    ends = o.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")).first()
    early = F.col("o_orderdate") < F.lit(ends["first"]) + F.expr("INTERVAL 7 DAYS")
    late = F.col("o_orderdate") > F.lit(ends["last"]) - F.expr("INTERVAL 7 DAYS")
    a = li.join(o, "l_orderkey").select("l_orderkey", F.col("l_partkey").cast("long").alias("src"), early.alias("early"), late.alias("late"))
    k = li.count()
    pairs = spread(a, k, "l_orderkey").join(spread(li.select("l_orderkey", F.col("l_partkey").cast("long").alias("dst")), k, "l_orderkey"), "l_orderkey").where("src > dst")
    pairs = spread(pairs, 2 * k, "src", "dst")
    k = materialize(pairs.groupBy("src", "dst").agg(F.count_if(~F.col("late")).alias("before"), F.count("*").alias("between"), F.count_if(~F.col("early")).alias("after")).where("between >= 2"), "weeks")

    def events(kind: str, which: str) -> DataFrame:
        return k.where(which).select(F.monotonically_increasing_id().alias("seq"), F.lit(kind).alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("w"))

    v = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"))
    g = Graph(v, k.where("before >= 2").select("src", "dst", F.lit(1.0).alias("weight")))
    return U.Watched(g), [events("EDGE_ADDITION", "before < 2"), events("EDGE_REMOVAL", "after < 2")]


def _followed(name: str, make, sql: str | None, look) -> None:
    """The result of what make(watched) keeps up, after both weeks."""

    def run(spark, sf_dir) -> DataFrame:
        watched, batches = _weeks(spark, sf_dir)
        kept = make(watched).run()
        for b in batches:
            watched.apply(b)
        return look(kept.result)

    query(name, sql)(run)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("node", (F.round("score", 6) + 0.0).alias("score"))


_followed("dynamics_betweenness_strong", K.KeptBetweenness, _PATHS + """, z(k, a, b, p, own) AS (SELECT k, a, b, p, CAST(0 AS DOUBLE) FROM w WHERE k = (SELECT max(k) FROM w) UNION ALL
  SELECT w.k, w.a, w.b, w.p, coalesce(sum(w.p / c.p * (1 + c.own)), 0.0) FROM (SELECT DISTINCT k FROM z) m JOIN w ON w.k = m.k - 1 LEFT JOIN (SELECT s.u, z.a, z.p, z.own FROM s JOIN z ON z.b = s.v) c ON c.u = w.b AND c.a = w.a GROUP BY 1, 2, 3, 4)
  SELECT b AS node, round(coalesce(sum(own) FILTER (k > 0), 0.0), 6) + 0.0 AS score FROM z GROUP BY b""", _rounded)
_followed("dynamics_betweenness_of_node_strong", lambda w: K.KeptBetweennessOf(w, 1), _PATHS + """ SELECT CAST(1 AS BIGINT) AS node, round(coalesce(sum(f.p * t.p / w.p), 0.0), 6) + 0.0 AS score
  FROM w JOIN w f ON f.a = w.a AND f.b = 1 JOIN w t ON t.a = 1 AND t.b = w.b WHERE w.a <> 1 AND w.b <> 1 AND f.k + t.k = w.k""", _rounded)
_followed("dynamics_top_harmonic_strong", lambda w: K.KeptTopHarmonic(w, 10), _PATHS + """, q AS (SELECT a AS node, sum(CASE WHEN k > 0 THEN 1.0 / k ELSE 0.0 END) AS score FROM w GROUP BY a)
  SELECT node, round(score / ((SELECT count(*) FROM v) - 1), 6) + 0.0 AS score FROM q ORDER BY round(q.score, 9) DESC, node LIMIT 10""", _rounded)
_followed("dynamics_top_katz_strong", lambda w: K.KeptKatz(w, 10, alpha=0.005), _WEEKS + """, r(l, node, x) AS (SELECT 0, id, CAST(1 AS DOUBLE) FROM v UNION ALL SELECT l + 1, s.u, sum(x) FROM r JOIN s ON s.v = r.node WHERE l < 30 GROUP BY l, s.u)
  SELECT node FROM (SELECT node, sum(x * pow(0.005, l)) AS score FROM r GROUP BY node) ORDER BY round(score - 1, 12) DESC, node LIMIT 10""", lambda df: df.select("node"))


# files: what is written is read back
_BACK = PUR + " SELECT src, dst, weight FROM e"
_PLAIN = SUP + " SELECT src, dst, weight FROM e"


def _round_trip(name: str, write, read, sql: str, graph=purchases) -> None:
    def run(spark, sf_dir) -> DataFrame:
        import uuid

        from graphloom.plans.scratch import scratch_dir

        path = f"{scratch_dir(spark)}/file-{uuid.uuid4().hex}"
        write(graph(spark, sf_dir).materialized(), path)
        return read(spark, path)

    query(f"files_{name}", sql)(run)


def _register_files() -> None:
    from graphloom.operators.partitions import balanced_partition
    from graphloom.sources import files as L
    from graphloom.sources import formats as D

    e = lambda g: g.edges.select("src", "dst", "weight")
    _round_trip("edge_list", L.write_edge_list, lambda s, p: e(L.read_edge_list(s, p)), _BACK)
    _round_trip("edge_list_both_directions", lambda g, p: L.write_edge_list(g, p, both=True), lambda s, p: e(L.read_edge_list(s, p)), _BACK)
    _round_trip("named_edge_list", L.write_edge_list, lambda s, p: (lambda t: t[0].edges.join(t[1].select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(t[1].select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").select(F.greatest(F.col("a").cast("long"), F.col("b").cast("long")).alias("src"), F.least(F.col("a").cast("long"), F.col("b").cast("long")).alias("dst"), "weight"))(L.read_named_edge_list(s, p)), _BACK)
    _round_trip("metis", D.write_metis, lambda s, p: e(L.read_metis(s, p)), _PLAIN, supply)
    _round_trip("snap", D.write_snap, lambda s, p: L.read_snap(s, p).edges.select("src", "dst"), PUR + " SELECT src, dst FROM e")
    _round_trip("snap_remapped", D.write_snap, lambda s, p: D.read_snap_remapped(s, p)[0].edges.agg(F.count("*").alias("edges"), F.max(F.greatest("src", "dst")).alias("top")), PUR + " SELECT count(*) AS edges, (SELECT count(*) - 1 FROM d WHERE degree > 0) AS top FROM e")
    _round_trip("gml", D.write_gml, lambda s, p: e(D.read_gml(s, p)), _PLAIN, supply)
    _round_trip("matrix_market", lambda g, p: D.write_matrix_market(g.edges.toDF("i", "j", "v"), 10**6, 10**6, p), lambda s, p: D.read_matrix_market(s, p), SUP + " SELECT src AS i, dst AS j, weight AS v FROM e", supply)
    _round_trip("partition", lambda g, p: D.write_partition(balanced_partition(g, 4), p), lambda s, p: D.read_partition(s, p).agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities")), SUP + " SELECT count(*) AS nodes, 4 AS communities FROM v", supply)
    _round_trip("cover", lambda g, p: D.write_cover(balanced_partition(g, 4), p), lambda s, p: D.read_cover(s, p).agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities")), SUP + " SELECT count(*) AS nodes, 4 AS communities FROM v", supply)
    _round_trip("dgs", lambda g, p: D.write_dgs(U.difference(Graph(g.vertices, g.edges.where("false")), g), p), lambda s, p: D.read_dgs(s, p, mapped=False)[0].select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight")), _PLAIN, supply)


_register_files()
