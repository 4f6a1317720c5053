"""Graph queries over the driver tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, co_purchase, geography, trade
from graphloom.operators import algebra as A
from graphloom.operators import distances as X
from graphloom.operators import iterative as I
from graphloom.operators import partitions as P
from graphloom.operators import similarity as L
from graphloom.operators import sparsify as S
from graphloom.operators import structure as D
from graphloom.operators import triangles as T
from graphloom.registry import query
from graphloom.streaming import events as E

# SQL of the graphs: v(id), e(src, dst, weight), s(u, v, w) with both directions, d(node, degree, wd).
_E = """e AS MATERIALIZED (SELECT CAST(a.l_partkey AS BIGINT) AS src, CAST(b.l_partkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey > b.l_partkey GROUP BY 1, 2{having})"""
_REST = """, v AS (SELECT CAST(p_partkey AS BIGINT) AS id FROM part),
s AS (SELECT src AS u, dst AS v, weight AS w FROM e UNION ALL SELECT dst, src, weight FROM e),
d AS (SELECT id AS node, count(u) AS degree, coalesce(sum(w), 0.0) AS wd FROM v LEFT JOIN s ON u = id GROUP BY id)"""
CP = "WITH RECURSIVE " + _E.format(having="") + _REST
CP2 = "WITH RECURSIVE " + _E.format(having=" HAVING count(*) >= 2") + _REST
TR = """WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
v AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)"""
GEO = "WITH RECURSIVE e AS (SELECT CAST(n_regionkey + 1000 AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) AS dst, 1.0 AS weight FROM nation), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), s AS (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e)"
TRI = ", t AS (SELECT x.src AS c, x.dst AS b, y.dst AS a FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), tn AS (SELECT node, count(*) AS t FROM (SELECT unnest([a, b, c]) AS node FROM t) GROUP BY node)"


def strong(spark, sf_dir) -> Graph:
    return co_purchase(spark, sf_dir).filter_edges("weight >= 2")


def brands(spark, sf_dir) -> DataFrame:
    """Parts by p_partkey % 7: a partition to judge."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("node"), (F.col("p_partkey") % 7).cast("long").alias("community"))


PART = ", p AS (SELECT CAST(p_partkey AS BIGINT) AS node, CAST(p_partkey % 7 AS BIGINT) AS community FROM part), l AS (SELECT e.*, x.community AS a, y.community AS b FROM e JOIN p x ON x.node = src JOIN p y ON y.node = dst)"


def _simple(name: str, graph, op, sql: str | None) -> None:
    query(name, sql)(lambda spark, sf, graph=graph, op=op: op(graph(spark, sf)))


_simple("structure_degrees", co_purchase, D.degrees, CP + " SELECT node, degree, wd AS weighted_degree FROM d")
_simple("structure_degrees_directed", trade, D.degrees, TR + " SELECT id AS node, count(src) AS degree, coalesce(sum(weight), 0.0) AS weighted_degree FROM v LEFT JOIN e ON src = id GROUP BY id")
_simple("structure_in_degrees", trade, D.in_degrees, TR + " SELECT id AS node, count(dst) AS degree, coalesce(sum(weight), 0.0) AS weighted_degree FROM v LEFT JOIN e ON dst = id GROUP BY id")
_simple("structure_isolated", strong, D.isolated, CP2 + " SELECT node FROM d WHERE degree = 0")
_simple("structure_size", co_purchase, D.size, CP + " SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, count(*) FILTER (src = dst) AS self_loops, sum(weight) AS total_weight, 2.0 * count(*) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS density FROM e")
_simple("structure_size_directed", trade, D.size, TR + " SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, count(*) FILTER (src = dst) AS self_loops, sum(weight) AS total_weight, 1.0 * count(*) FILTER (src <> dst) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS density FROM e")
_simple("structure_degree_distribution", co_purchase, D.degree_distribution, CP + " SELECT degree, count(*) AS nodes FROM d GROUP BY degree")
_simple("centrality_degree", co_purchase, D.degree_centrality, CP + " SELECT node, degree / (SELECT count(*) - 1.0 FROM v) AS score FROM d")
_simple("centrality_sfigality", co_purchase, D.sfigality, CP + " SELECT d.node, coalesce(x.sc, 0.0) AS score FROM d LEFT JOIN (SELECT s.u, count(*) FILTER (b.degree > a.degree) * 1.0 / any_value(a.degree) AS sc FROM s JOIN d a ON a.node = s.u JOIN d b ON b.node = s.v GROUP BY s.u) x ON x.u = d.node")
_simple("centrality_laplacian", co_purchase, D.laplacian_centrality, CP + " SELECT d.node, floor(wd) * floor(wd) + coalesce(x.sc, 0.0) AS score FROM d LEFT JOIN (SELECT s.u, sum(w * (w + 2 * b.wd)) AS sc FROM s JOIN d b ON b.node = s.v GROUP BY s.u) x ON x.u = d.node")
_simple("correlation_degree_assortativity", co_purchase, D.degree_assortativity, CP + " SELECT corr(CAST(a.degree AS DOUBLE), CAST(b.degree AS DOUBLE)) AS assortativity FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst")
_simple("structure_transpose", trade, lambda g: D.transpose(g).edges, TR + " SELECT dst AS src, src AS dst, weight FROM e")
_simple("structure_to_undirected", trade, lambda g: D.to_undirected(g).edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), TR + " SELECT greatest(src, dst) AS src, least(src, dst) AS dst, count(*) AS n, sum(weight) AS weight FROM e GROUP BY 1, 2")
_simple("structure_subgraph", co_purchase, lambda g: D.subgraph(g, g.vertices.where("id % 3 = 0")).edges, CP + " SELECT src, dst, weight FROM e WHERE src % 3 = 0 AND dst % 3 = 0")
_simple("structure_adjacency", strong, lambda g: g.adjacency().select("src", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs")), CP2 + " SELECT u AS src, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS nbrs FROM s GROUP BY u")
_simple("structure_merge", co_purchase, lambda g: D.merge(g.filter_edges("weight >= 2"), g.filter_edges("src % 5 = 0")).edges, CP + " SELECT src, dst, weight FROM e WHERE weight >= 2 OR src % 5 = 0")
_simple("triangles_by_node", co_purchase, T.triangles_by_node, CP + TRI + " SELECT id AS node, coalesce(t, 0) AS triangles FROM v LEFT JOIN tn ON node = id")
_simple("triangles_by_edge", strong, T.triangles_by_edge, CP2 + TRI + " SELECT src, dst, (SELECT count(*) FROM t WHERE (c = src AND b = dst) OR (b = src AND a = dst) OR (c = src AND a = dst)) AS triangles FROM e")
_simple("centrality_local_clustering", co_purchase, T.local_clustering, CP + TRI + " SELECT d.node, CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0.0 END AS score FROM d LEFT JOIN tn ON tn.node = d.node")
_simple("global_clustering", co_purchase, T.global_clustering, CP + TRI + " SELECT sum(2.0 * coalesce(t, 0)) / sum(degree * (degree - 1)) AS transitivity, avg(2.0 * coalesce(t, 0) / (degree * (degree - 1))) AS average_local FROM d LEFT JOIN tn ON tn.node = d.node WHERE degree > 1")
_simple("linkprediction_common_neighbours", strong, L.common_neighbours, CP2 + " SELECT x.v AS u, y.v AS v, count(*) AS common, sum(1 / ln(degree)) AS adamic_adar, sum(1.0 / degree) AS resource_allocation FROM s x JOIN s y ON x.u = y.u AND x.v < y.v JOIN d ON node = x.u GROUP BY 1, 2")
_simple(
    "linkprediction_indices", co_purchase, lambda g: L.predict(g, g.edges.where("weight >= 2").select(F.col("src").alias("u"), F.col("dst").alias("v"))),
    CP + ", q AS (SELECT src AS u, dst AS v FROM e WHERE weight >= 2), c AS (SELECT q.u, q.v, count(*) AS k, sum(1 / ln(degree)) AS aa, sum(1.0 / degree) AS ra FROM q JOIN s x ON x.u = q.u JOIN s y ON y.u = q.v AND y.v = x.v JOIN d ON node = x.v GROUP BY 1, 2)"
    " SELECT q.u, q.v, coalesce(k, 0) AS common, coalesce(k, 0) * 1.0 / (a.degree + b.degree - coalesce(k, 0)) AS jaccard, a.degree + b.degree - coalesce(k, 0) AS total_neighbours, a.degree * b.degree AS preferential_attachment,"
    " coalesce(aa, 0.0) AS adamic_adar, coalesce(ra, 0.0) AS resource_allocation, coalesce(k, 0) / sqrt(a.degree * b.degree) AS neighbourhood_distance FROM q LEFT JOIN c ON c.u = q.u AND c.v = q.v JOIN d a ON a.node = q.u JOIN d b ON b.node = q.v",
)
_simple("edgescores_similarity", strong, L.edge_scores, CP2 + TRI + ", te AS (SELECT src, dst, count(*) AS k FROM (SELECT c AS src, b AS dst FROM t UNION ALL SELECT b, a FROM t UNION ALL SELECT c, a FROM t) GROUP BY 1, 2) SELECT e.src, e.dst, coalesce(k, 0) AS triangles, 1 - coalesce(k, 0) * 1.0 / (a.degree + b.degree - coalesce(k, 0)) AS jaccard_distance, (coalesce(k, 0) + 1) / sqrt((a.degree + 1) * (b.degree + 1)) AS scan FROM e LEFT JOIN te ON te.src = e.src AND te.dst = e.dst JOIN d a ON a.node = e.src JOIN d b ON b.node = e.dst")
_LOCAL = " SELECT greatest(u, v) AS src, least(u, v) AS dst, max(CASE WHEN k > 1 THEN 1 - ln(r) / ln(k) ELSE 1.0 END) AS score FROM r GROUP BY 1, 2"
_simple("sparsify_local_degree", co_purchase, S.local_degree, CP + ", r AS (SELECT u, v, rank() OVER (PARTITION BY u ORDER BY degree DESC) AS r, count(*) OVER (PARTITION BY u) AS k FROM s JOIN d ON node = v)" + _LOCAL)
_simple("sparsify_local_filter", co_purchase, lambda g: S.local_filter(g, g.edges.withColumnRenamed("weight", "score")), CP + ", r AS (SELECT u, v, rank() OVER (PARTITION BY u ORDER BY w DESC) AS r, count(*) OVER (PARTITION BY u) AS k FROM s)" + _LOCAL)
_simple("sparsify_disparity", co_purchase, S.disparity, CP + " SELECT greatest(u, v) AS src, least(u, v) AS dst, max(1 - pow(1 - w / wd, degree - 1)) AS score FROM s JOIN d ON node = u GROUP BY 1, 2")
_simple("sparsify_normalised", co_purchase, lambda g: S.normalised(g.edges.withColumnRenamed("weight", "score"), invert=True), CP + " SELECT src, dst, 1 - (weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()) AS score FROM e")
_simple("sparsify_threshold", co_purchase, lambda g: S.above(g, S.disparity(g), 0.9).edges, CP + ", f AS (SELECT greatest(u, v) AS src, least(u, v) AS dst, max(1 - pow(1 - w / wd, degree - 1)) AS score FROM s JOIN d ON node = u GROUP BY 1, 2) SELECT e.* FROM e JOIN f USING (src, dst) WHERE score >= 0.9")


def _judge(name: str, op, sql: str) -> None:
    query(name, CP + PART + sql)(lambda spark, sf, op=op: op(co_purchase(spark, sf), brands(spark, sf)))


_judge("community_sizes", lambda g, p: P.community_sizes(p), " SELECT community, count(*) AS size FROM p GROUP BY 1")
_judge("community_coverage", P.coverage, " SELECT sum(weight) FILTER (a = b) / sum(weight) AS coverage FROM l")
_judge("community_edge_cut", P.edge_cut, " SELECT sum(weight) AS edge_cut FROM l WHERE a <> b")
_judge("community_modularity", P.modularity, ", vol AS (SELECT c, sum(weight) AS x FROM (SELECT a AS c, weight FROM l UNION ALL SELECT b, weight FROM l) GROUP BY c) SELECT (SELECT sum(weight) FILTER (a = b) / sum(weight) FROM l) - (SELECT sum(x * x) FROM vol) / (4 * (SELECT sum(weight) FROM l) ** 2) AS modularity")
_judge("community_report", P.community_report, ", y AS (SELECT a AS c, b AS o, weight FROM l UNION ALL SELECT b, a, weight FROM l), z AS (SELECT c, sum(weight) AS volume, coalesce(sum(weight) FILTER (o <> c), 0.0) AS cut FROM y GROUP BY c), n AS (SELECT community, count(*) AS size FROM p GROUP BY 1), tot AS (SELECT 2 * sum(weight) AS w FROM l) SELECT community, size, (volume - cut) / 2 AS inner_weight, cut, volume, cut / least(volume, w - volume) AS conductance, cut / least(size, (SELECT count(*) FROM p) - size) AS expansion FROM n JOIN z ON c = community, tot")
_judge("community_imbalance", lambda g, p: P.imbalance(p), " SELECT max(k) / ceil(sum(k) * 1.0 / count(*)) AS imbalance FROM (SELECT count(*) AS k FROM p GROUP BY community)")
_judge("community_hub_dominance", P.hub_dominance, ", i AS (SELECT a AS c, node, count(*) AS k FROM (SELECT a, src AS node FROM l WHERE a = b UNION ALL SELECT a, dst FROM l WHERE a = b) GROUP BY 1, 2) SELECT community, max(k) * 1.0 / (any_value(size) - 1) AS dominance FROM i JOIN (SELECT community, count(*) AS size FROM p GROUP BY 1) ON community = c GROUP BY 1")
_judge("community_coarsening", lambda g, p: P.coarsened(g, p).edges, " SELECT greatest(a, b) AS src, least(a, b) AS dst, sum(weight) AS weight FROM l GROUP BY 1, 2")
_judge("community_inside_outside", P.weighted_degree_within, ", y AS (SELECT src AS n, a, b, weight FROM l UNION ALL SELECT dst, b, a, weight FROM l) SELECT node, coalesce(sum(weight) FILTER (a = b), 0.0) AS inside, coalesce(sum(weight) FILTER (a <> b), 0.0) AS outside FROM p LEFT JOIN y ON n = node GROUP BY node")
_judge(
    "community_compared", lambda g, p: P.compared(p, p.withColumn("community", F.col("node") % 5)),
    ", k AS (SELECT community AS a, node % 5 AS b, CAST(count(*) AS DOUBLE) AS k FROM p GROUP BY 1, 2), x AS (SELECT sum(k) AS k FROM k GROUP BY a), y AS (SELECT sum(k) AS k FROM k GROUP BY b), f AS (SELECT (SELECT sum(k) FROM k) AS n, (SELECT sum(k * (k - 1) / 2) FROM k) AS s, (SELECT sum(k * (k - 1) / 2) FROM x) AS sa, (SELECT sum(k * (k - 1) / 2) FROM y) AS sb, (SELECT sum(k * log2(k)) FROM k) AS kl, (SELECT sum(k * log2(k)) FROM x) AS al, (SELECT sum(k * log2(k)) FROM y) AS bl)"
    " SELECT (sa + sb - 2 * s) / (n * (n - 1) / 2) AS rand, 1 - s / (sa + sb - s) AS jaccard, 1 - 2 * (log2(n) - al / n + log2(n) - bl / n - log2(n) + kl / n) / (2 * log2(n) - al / n - bl / n) AS nmi_distance FROM f",
)
query("correlation_nominal_assortativity", CP + PART + ", m AS (SELECT x, y, count(*) AS k FROM (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l) GROUP BY 1, 2), t AS (SELECT sum(k) AS m, sum(k) FILTER (x = y) AS same FROM m), q AS (SELECT sum(k * k) AS ab FROM (SELECT CAST(sum(k) AS DOUBLE) AS k FROM m GROUP BY x)) SELECT (same / m - ab / (m * m)) / (1 - ab / (m * m)) AS assortativity FROM t, q")(
    lambda spark, sf: D.nominal_assortativity(co_purchase(spark, sf), brands(spark, sf).withColumnRenamed("community", "type"))
)


def _matrix(g: Graph) -> DataFrame:
    return g.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))


_simple("algebra_mxm", trade, lambda g: A.mxm(_matrix(g), _matrix(g)), TR + " SELECT x.src AS i, y.dst AS j, sum(x.weight * y.weight) AS v FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2")
_simple("algebra_mxm_min_plus", trade, lambda g: A.mxm(_matrix(g), _matrix(g), "min_plus"), TR + " SELECT x.src AS i, y.dst AS j, min(x.weight + y.weight) AS v FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2")
_simple("algebra_mxv", trade, lambda g: A.mxv(_matrix(g), g.vertices.select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))), TR + " SELECT src AS i, sum(weight * dst) AS v FROM e GROUP BY 1")
_simple("algebra_ewise_add", trade, lambda g: A.ewise_add(_matrix(g), _matrix(D.transpose(g))), TR + " SELECT coalesce(x.src, y.dst) AS i, coalesce(x.dst, y.src) AS j, coalesce(x.weight, 0.0) + coalesce(y.weight, 0.0) AS v FROM e x FULL JOIN e y ON x.src = y.dst AND x.dst = y.src")
_simple("algebra_ewise_mult", trade, lambda g: A.ewise_mult(_matrix(g), _matrix(D.transpose(g))), TR + " SELECT x.src AS i, x.dst AS j, x.weight * y.weight AS v FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src")
_simple("algebra_row_reduce", trade, lambda g: A.row_reduce(_matrix(g)), TR + " SELECT src AS i, sum(weight) AS v FROM e GROUP BY 1")
_simple("algebra_column_reduce", trade, lambda g: A.column_reduce(_matrix(g), "max_plus"), TR + " SELECT dst AS i, max(weight) AS v FROM e GROUP BY 1")

_REACH = ", r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, s.v FROM r JOIN s ON s.u = r.b)"
_simple("components_connected", geography, I.connected_components, GEO + _REACH + " SELECT a AS node, min(b) AS component FROM r GROUP BY 1")
_simple("components_strong", lambda s, d: trade(s, d).filter_edges("(src + dst) % 4 = 1 OR src = dst + 2"), I.strongly_connected_components, TR + ", f AS (SELECT src, dst FROM e WHERE (src + dst) % 4 = 1 OR src = dst + 2), r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, f.dst FROM r JOIN f ON f.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")
_simple("distance_bfs", strong, lambda g: I.bfs(g, g.vertices.where("id = 1")).select("node", "distance"), CP2 + ", r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS h UNION SELECT s.v, h + 1 FROM r JOIN s ON s.u = node WHERE h < 25) SELECT node, min(h) AS distance FROM r GROUP BY 1")


def _dijkstra(g: Graph) -> DataFrame:
    return I.shortest_paths(g, g.vertices.where("id = 0"))


_simple("distance_sssp", lambda s, d: trade(s, d).filter_edges("(src * 7 + dst) % 5 = 0"), _dijkstra, TR + ", f AS (SELECT * FROM e WHERE (src * 7 + dst) % 5 = 0), r AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS x, 0 AS h UNION SELECT f.dst, x + weight, h + 1 FROM r JOIN f ON f.src = node WHERE h < 6) SELECT node, min(x) AS distance FROM r GROUP BY 1")

# components_strong and distance_sssp take a part of the edges, which bounds the walks of their SQL. These take all of them.
_simple("components_strong_trade", trade, I.strongly_connected_components, TR + ", r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")


def _relaxed_sql(rounds: int) -> str:
    """Least weights from node 0 by rounds that relax every edge: exact after as many as there are nodes, less one."""
    steps = ["x0 AS (SELECT id AS node, CAST(0 AS DOUBLE) AS x FROM v WHERE id = 0)"]
    for k in range(rounds):
        steps.append(f"x{k + 1} AS MATERIALIZED (SELECT node, min(x) AS x FROM (SELECT node, x FROM x{k} UNION ALL SELECT e.dst, x + weight FROM x{k} JOIN e ON e.src = node) GROUP BY node)")
    return TR + ", " + ", ".join(steps) + f" SELECT node, x AS distance FROM x{rounds}"


_simple("distance_sssp_trade", trade, _dijkstra, _relaxed_sql(24))  # 25 nations


def _pagerank_sql(rounds: int) -> str:
    steps = ["x0 AS (SELECT id, 1.0 / (SELECT count(*) FROM v) AS x FROM v)"]
    for k in range(rounds):
        steps.append(f"x{k + 1} AS (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(sum(x{k}.x * s.w / d.wd), 0.0) AS x FROM v LEFT JOIN s ON s.v = v.id LEFT JOIN d ON d.node = s.u LEFT JOIN x{k} ON x{k}.id = s.u GROUP BY v.id)")
    return CP + ", " + ", ".join(steps) + f" SELECT id AS node, x AS score FROM x{rounds}"


_simple("centrality_pagerank", co_purchase, lambda g: I.pagerank(g, iterations=8, tol=0.0), _pagerank_sql(8))
_simple("centrality_eigenvector", co_purchase, lambda g: I.eigenvector(g, iterations=30).select("node", F.round("score", 6).alias("score")), None)
_simple("centrality_katz", co_purchase, lambda g: I.katz(g, iterations=30).select("node", F.round("score", 6).alias("score")), None)
_simple("centrality_core", strong, I.core_numbers, None)
_simple("community_label_propagation", strong, I.label_propagation, None)
_simple("matching_greedy", strong, I.greedy_matching, None)
_simple("components_spanning_forest", strong, I.spanning_forest, None)

_HOPS = ", h AS (SELECT id AS a, id AS b, 0 AS k FROM v UNION SELECT h.a, s.v, k + 1 FROM h JOIN s ON s.u = h.b WHERE k < 4), hd AS (SELECT a, b, min(k) AS k FROM h GROUP BY 1, 2)"  # regions are stars
_simple("distance_all_pairs", geography, lambda g: X.distances(g).drop("paths"), GEO + _HOPS + " SELECT a AS source, b AS node, k AS distance FROM hd")
_simple("centrality_closeness_generalized", geography, lambda g: X.closeness(g, generalized=True), GEO + _HOPS + " SELECT a AS node, CASE WHEN sum(k) > 0 THEN (count(*) - 1) * (count(*) - 1) / CAST(sum(k) AS DOUBLE) / ((SELECT count(*) FROM v) - 1) ELSE 0.0 END AS score FROM hd GROUP BY 1")
_simple("centrality_harmonic_closeness", geography, X.harmonic_closeness, GEO + _HOPS + " SELECT a AS node, sum(CASE WHEN k > 0 THEN 1.0 / k ELSE 0.0 END) / CAST((SELECT count(*) FROM v) - 1 AS DOUBLE) AS score FROM hd GROUP BY 1")
_simple("distance_eccentricity", geography, X.eccentricity, GEO + _HOPS + " SELECT a AS node, max(k) AS eccentricity FROM hd GROUP BY 1")
_simple("distance_diameter", geography, X.diameter, GEO + _HOPS + " SELECT max(k) AS diameter, min(k) AS radius FROM (SELECT max(k) AS k FROM hd GROUP BY a)")
_simple("distance_distribution", geography, X.distance_distribution, GEO + _HOPS + " SELECT k AS distance, count(*) AS pairs FROM hd WHERE k > 0 GROUP BY 1")
_simple("centrality_betweenness", geography, X.betweenness, None)
# Geography is a forest of 30 nodes. The same measures of all strong co-purchases, which are too many walks for SQL.
_simple("components_connected_strong", strong, I.connected_components, None)
_simple("distance_eccentricity_strong", strong, X.eccentricity, None)
_simple("distance_distribution_strong", strong, X.distance_distribution, None)
_simple("distance_diameter_strong", strong, X.diameter, None)
_simple("centrality_closeness_strong", strong, lambda g: X.closeness(g, generalized=True), None)
_simple("centrality_harmonic_closeness_strong", strong, X.harmonic_closeness, None)
_simple("centrality_betweenness_strong", strong, X.betweenness, None)


@query("dynamics_replay", "WITH x AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) SELECT user_id AS u, event_id % 20 AS v, CAST(count(*) AS DOUBLE) AS w FROM x GROUP BY 1, 2")
def dynamics_replay(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_id").alias("seq"), F.lit("EDGE_WEIGHT_INCREMENT").alias("type"), F.col("user_id").alias("u"), (F.col("event_id") % 20).alias("v"), F.lit(1.0).alias("w"))
    return E.replay(rows)


@query("dynamics_transitions", "SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2")
def dynamics_transitions(spark, sf_dir) -> DataFrame:
    return E.transitions(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", ["ts", "event_id"])
