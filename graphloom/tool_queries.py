"""Queries of graph tools, paths, centralities, partitions, edge scores and prediction, each over a whole graph, with SQL where it can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, co_purchase, trade, shared_orders
from graphloom.graph_queries import CP, CP2, PART, TR, TRI, _simple, brands, strong
from graphloom.operators import algebra as A
from graphloom.operators import blocks as K
from graphloom.operators import centralities as C
from graphloom.operators import community as M
from graphloom.operators import edge_scores as E
from graphloom.operators import iterative as I
from graphloom.operators import matchings as B
from graphloom.operators import partitions as P
from graphloom.operators import paths as X
from graphloom.operators import prediction as L
from graphloom.operators import toolbox as T
from graphloom.operators.codelength import shortened
from graphloom.plans.spread import spread
from graphloom.registry import query

CUSTOMERS, SUPPLIERS, REGIONS = 10**12, 2 * 10**12, 3 * 10**12


def territory(spark, sf_dir) -> Graph:
    """Regions, their nations, and the customers and suppliers of those: a forest that grows with the data. Customers weigh 1 to 3."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "customer", "supplier")}
    row = lambda df, a, b, w: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"), w.cast("double").alias("weight"))
    e = row(t["nation"], F.col("n_regionkey") + F.lit(REGIONS), F.col("n_nationkey"), F.lit(2.0))
    e = e.union(row(t["customer"], F.col("c_custkey") + F.lit(CUSTOMERS), F.col("c_nationkey"), 1 + F.col("c_custkey") % 3)).union(row(t["supplier"], F.col("s_suppkey") + F.lit(SUPPLIERS), F.col("s_nationkey"), F.lit(1.0)))
    return Graph.from_edges(e, multi="keep")


def downward(spark, sf_dir) -> Graph:
    """The same, every arc leading away from the region."""
    g = territory(spark, sf_dir)
    region = F.col("src") >= REGIONS
    return Graph(g.vertices, g.edges.select(F.when(region, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(region, F.col("dst")).otherwise(F.col("src")).alias("dst"), "weight"), True)


def supply(spark, sf_dir) -> Graph:
    """Suppliers that served one order, weighted by how often."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    e = shared_orders(li, "l_suppkey").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return Graph(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id")), e.select(F.col("src").cast("long"), F.col("dst").cast("long"), "weight"))


def purchases(spark, sf_dir) -> Graph:
    """Customers and the suppliers they bought from: bipartite, weighted by lineitems."""
    li, o = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = li.count()
    rows = spread(li, k, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_suppkey") + F.lit(SUPPLIERS)).alias("src"), (F.col("o_custkey") + F.lit(CUSTOMERS)).alias("dst"))
    e = spread(rows, k, "src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    v = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") + F.lit(CUSTOMERS)).alias("id")).union(spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") + F.lit(SUPPLIERS)).alias("id")))
    return Graph(v, e)


_S = ", s AS (SELECT src AS u, dst AS v, weight AS w FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst), d AS (SELECT id AS node, count(u) AS degree, coalesce(sum(w), 0.0) AS wd FROM v LEFT JOIN s ON u = id GROUP BY id)"
TER = (
    f"WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(n_regionkey AS BIGINT) + {REGIONS} AS src, CAST(n_nationkey AS BIGINT) AS dst, 2.0 AS weight FROM nation"
    f" UNION ALL SELECT c_custkey + {CUSTOMERS}, CAST(c_nationkey AS BIGINT), 1.0 + c_custkey % 3 FROM customer UNION ALL SELECT s_suppkey + {SUPPLIERS}, CAST(s_nationkey AS BIGINT), 1.0 FROM supplier),"
    " v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)" + _S
)
SUP = (
    "WITH RECURSIVE e AS MATERIALIZED (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey > b.l_suppkey GROUP BY 1, 2),"
    " v AS (SELECT s_suppkey AS id FROM supplier)" + _S
)
PUR = (
    f"WITH RECURSIVE e AS MATERIALIZED (SELECT l_suppkey + {SUPPLIERS} AS src, o_custkey + {CUSTOMERS} AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),"
    f" v AS (SELECT c_custkey + {CUSTOMERS} AS id FROM customer UNION ALL SELECT s_suppkey + {SUPPLIERS} FROM supplier)" + _S
)
# all pairs of the forest: a walk never turns back, so a path is a walk that doesn't step to where it came from
_FOREST = ", w AS (SELECT id AS a, id AS b, CAST(-1 AS BIGINT) AS last, 0 AS k, CAST(0 AS DOUBLE) AS x FROM v UNION ALL SELECT w.a, s.v, w.b, k + 1, x + s.w FROM w JOIN s ON s.u = w.b AND s.v <> w.last)"
_SMALL = "SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_size <= 10"


def small(spark, sf_dir) -> DataFrame:
    """Parts of size 10 at most: a node set for operators that take one."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size <= 10").select(F.col("p_partkey").cast("long").alias("id"))


def stock(spark, sf_dir) -> DataFrame:
    """(src, dst): part and supplier numbers of lineitems, taken as pairs of parts."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


_STOCK = ", k AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey), kk AS (SELECT DISTINCT greatest(a, b) AS src, least(a, b) AS dst FROM k)"


def _on(name: str, op, sql: str | None = None, graph=co_purchase) -> None:
    """op(g, spark, sf_dir) over a graph."""
    query(name, sql)(lambda spark, sf, op=op, graph=graph: op(graph(spark, sf), spark, sf))


def _edges(g: Graph) -> DataFrame:
    return g.edges.select("src", "dst", "weight")


# tools
_simple("structure_node_id_bound", co_purchase, T.upper_node_id_bound, CP + " SELECT max(id) + 1 AS bound FROM v")
_on("structure_has_nodes", lambda g, s, d: T.has_nodes(g, s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id")).distinct()), CP + " SELECT DISTINCT o_custkey AS id, o_custkey IN (SELECT id FROM v) AS present FROM orders")
_on("structure_edge_weights", lambda g, s, d: T.edge_weights(g, stock(s, d).toDF("u", "v")), CP + _STOCK + " SELECT a AS u, b AS v, weight IS NOT NULL AS present, coalesce(weight, 0.0) AS weight FROM k LEFT JOIN e ON src = greatest(a, b) AND dst = least(a, b)")
_on("structure_ith_neighbours", lambda g, s, d: T.ith_neighbours(g, g.vertices.select(F.col("id").alias("u"), F.lit(2).alias("i"))), CP + ", q AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY v) AS r FROM s) SELECT id AS u, 2 AS i, q.v AS neighbour, q.w AS weight FROM v LEFT JOIN q ON q.u = id AND r = 3")
_simple("structure_parallel_edges", trade, lambda g: T.parallel_edges(Graph.from_edges(g.edges, vertices=g.vertices, multi="keep")), TR + " SELECT greatest(src, dst) AS src, least(src, dst) AS dst, count(*) AS copies FROM e GROUP BY 1, 2 HAVING count(*) > 1")
_simple("structure_indexed_edges", co_purchase, T.indexed_edges, CP + " SELECT src, dst, weight, row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM e")
_simple("structure_max_degrees", co_purchase, T.max_degrees, CP + " SELECT max(degree) AS max_degree, max(degree) AS max_in_degree, max(wd) AS max_weighted_degree, max(wd) AS max_weighted_in_degree FROM d")
_simple("structure_max_degrees_directed", trade, T.max_degrees, TR + ", o AS (SELECT count(*) AS k, sum(weight) AS w FROM e GROUP BY src), i AS (SELECT count(*) AS k, sum(weight) AS w FROM e GROUP BY dst) SELECT (SELECT max(k) FROM o) AS max_degree, (SELECT max(k) FROM i) AS max_in_degree, (SELECT max(w) FROM o) AS max_weighted_degree, (SELECT max(w) FROM i) AS max_weighted_in_degree")
_on("structure_volume", lambda g, s, d: T.volume(g, small(s, d)), CP + f" SELECT sum(wd) AS volume FROM d WHERE node IN ({_SMALL})")
_simple("structure_in_volume", trade, lambda g: T.volume(g, incoming=True), TR + " SELECT sum(weight) AS volume FROM e")
_simple("structure_weighted_in_degrees", trade, lambda g: T.weighted_degrees(g, loops_twice=True, incoming=True), TR + " SELECT id AS node, coalesce(sum(CASE WHEN src = dst THEN 2 * weight ELSE weight END), 0.0) AS weighted_degree FROM v LEFT JOIN e ON dst = id GROUP BY id")
_on("structure_add_nodes", lambda g, s, d: T.add_nodes(g, s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))).vertices, CP + " SELECT id FROM v UNION SELECT o_orderkey FROM orders")
_on("structure_remove_nodes", lambda g, s, d: T.remove_nodes(g, small(s, d)).edges, CP + f" SELECT src, dst, weight FROM e WHERE src NOT IN ({_SMALL}) AND dst NOT IN ({_SMALL})")
_on("structure_add_edges", lambda g, s, d: _edges(T.add_edges(g, stock(s, d).withColumn("weight", F.lit(7.0)), check=True)), CP + _STOCK + " SELECT src, dst, weight FROM e UNION ALL SELECT src, dst, 7.0 FROM kk ANTI JOIN e USING (src, dst)")
_on("structure_remove_edges", lambda g, s, d: _edges(T.remove_edges(g, stock(s, d))), CP + _STOCK + " SELECT src, dst, weight FROM e ANTI JOIN kk USING (src, dst)")
_on("structure_remove_adjacent_edges", lambda g, s, d: _edges(T.remove_adjacent_edges(g, small(s, d), "weight < 2")), CP + f" SELECT src, dst, weight FROM e WHERE NOT ((src IN ({_SMALL}) OR dst IN ({_SMALL})) AND weight < 2)")
_on("structure_remove_edges_from", lambda g, s, d: _edges(T.remove_edges_from_isolated_set(g, g.vertices.join(s.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("id")), "id", "left_semi"))), TR + " SELECT src, dst, weight FROM e WHERE src NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", trade)
_simple("structure_remove_self_loops", trade, lambda g: _edges(T.remove_self_loops(g)), TR + " SELECT src, dst, weight FROM e WHERE src <> dst")
_simple("structure_remove_multi_edges", trade, lambda g: _edges(T.remove_multi_edges(Graph.from_edges(g.edges, multi="keep"))), TR + " SELECT greatest(src, dst) AS src, least(src, dst) AS dst, min(weight) AS weight FROM e GROUP BY 1, 2")
_on("structure_set_weights", lambda g, s, d: _edges(T.set_weights(g, stock(s, d).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().withColumn("weight", F.lit(9.0)))), CP + _STOCK + " SELECT src, dst, CASE WHEN kk.src IS NOT NULL THEN 9.0 ELSE weight END AS weight FROM e FULL JOIN kk USING (src, dst)".replace("kk.src IS NOT NULL", "(src, dst) IN (SELECT src, dst FROM kk)"))
_on("structure_increase_weights", lambda g, s, d: _edges(T.set_weights(g, stock(s, d).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().withColumn("weight", F.lit(9.0)), increase=True)), CP + _STOCK + " SELECT src, dst, coalesce(weight, 0.0) + CASE WHEN (src, dst) IN (SELECT src, dst FROM kk) THEN 9.0 ELSE 0.0 END AS weight FROM e FULL JOIN kk USING (src, dst)")
_simple("structure_unweighted", co_purchase, lambda g: _edges(T.unweighted(g)), CP + " SELECT src, dst, 1.0 AS weight FROM e")
_on("structure_append", lambda g, s, d: _edges(T.append(g, supply(s, d))), CP + ", f AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey > b.l_suppkey GROUP BY 1, 2) SELECT src, dst, weight FROM e UNION ALL SELECT src + (SELECT max(id) + 1 FROM v), dst + (SELECT max(id) + 1 FROM v), weight FROM f")
_simple("structure_augmented", co_purchase, lambda g: _edges(T.augmented(g)), CP + " SELECT src, dst, weight FROM e UNION ALL SELECT (SELECT max(id) + 1 FROM v), id, 1.0 FROM v")
_simple("structure_compacted", territory, lambda g: _edges(T.compacted(g)), TER + ", n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) SELECT greatest(a.k, b.k) AS src, least(a.k, b.k) AS dst, weight FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst")
_on("structure_subgraph_and_neighbours", lambda g, s, d: _edges(T.subgraph_and_neighbours(g, small(s, d))), CP + f" SELECT src, dst, weight FROM e WHERE src IN ({_SMALL}) OR dst IN ({_SMALL})")
_simple("structure_topological_order", downward, T.topological_order, TER + f", l AS (SELECT id AS node, CASE WHEN id >= {REGIONS} THEN 0 WHEN id >= {CUSTOMERS} THEN 2 ELSE 1 END AS layer FROM v) SELECT node, layer, row_number() OVER (ORDER BY layer, node) - 1 AS position FROM l")
_simple("structure_is_bipartite", purchases, T.is_bipartite, PUR + f", c AS (SELECT min(id) AS m FROM v) SELECT true AS bipartite, (SELECT count(*) FROM customer) AS left_nodes, (SELECT count(*) FROM supplier) AS right_nodes")
_on("structure_bfs_edges", lambda g, s, d: T.bfs_edges(g, g.vertices.where(F.col("id") >= REGIONS)), TER + " SELECT dst AS parent, src AS node, 2 AS distance FROM e WHERE src < " + str(REGIONS) + " UNION ALL SELECT src, dst, 1 FROM e WHERE src >= " + str(REGIONS), territory)
_simple("structure_overview", co_purchase, T.overview, CP + " SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, 0 AS self_loops, sum(weight) AS total_weight, 2.0 * count(*) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS density, (SELECT min(degree) FROM d) AS min_degree, (SELECT max(degree) FROM d) AS max_degree, (SELECT avg(degree) FROM d) AS mean_degree, (SELECT count(*) FROM d WHERE degree = 0) AS isolated FROM e")
_on("statistics_gini", lambda g, s, d: T.gini(T.weighted_degrees(g).withColumnRenamed("weighted_degree", "value")), CP + ", r AS (SELECT wd, rank() OVER (ORDER BY wd) + (count(*) OVER (PARTITION BY wd) - 1) / 2.0 AS k FROM d) SELECT 2 * sum(k * wd) / (count(*) * sum(wd)) - (count(*) + 1.0) / count(*) AS gini FROM r")
_on("statistics_ranked", lambda g, s, d: T.ranked(T.weighted_degrees(g).withColumnRenamed("weighted_degree", "value")).select("node", "rank"), CP + " SELECT node, rank() OVER (ORDER BY wd) + (count(*) OVER (PARTITION BY wd) - 1) / 2.0 AS rank FROM d")
_on("structure_node_attribute", lambda g, s, d: T.node_attribute(T.with_node_attribute(g, "size", s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("value"))), "size"), "SELECT p_partkey AS node, p_size AS value FROM part")

# matrices
_m = lambda g: g.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))
_simple("algebra_adjacency", co_purchase, A.adjacency_matrix, CP + " SELECT u AS i, v AS j, w AS v FROM s")
_simple("algebra_laplacian", co_purchase, A.laplacian_matrix, CP + " SELECT node AS i, node AS j, wd AS v FROM d WHERE degree > 0 UNION ALL SELECT u, v, -w FROM s")
_simple("algebra_pagerank_matrix", trade, A.pagerank_matrix, TR + " SELECT dst AS i, src AS j, 0.85 * weight / sum(weight) OVER (PARTITION BY src) AS v FROM e")
_simple("algebra_mxm_max_min", trade, lambda g: A.mxm(_m(g), _m(g), "max_min"), TR + " SELECT x.src AS i, y.dst AS j, max(least(x.weight, y.weight)) AS v FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2")
_simple("algebra_mxm_min_max", trade, lambda g: A.mxm(_m(g), _m(g), "min_max"), TR + " SELECT x.src AS i, y.dst AS j, min(greatest(x.weight, y.weight)) AS v FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2")
_simple("algebra_mxm_logical", downward, lambda g: A.mxm(_m(g), _m(g), "logical"), TER + f" SELECT x.src AS i, y.src AS j, 1 AS v FROM e x JOIN e y ON x.dst = y.dst WHERE x.src >= {REGIONS} AND y.src < {REGIONS}")
_simple("algebra_mxm_galois", trade, lambda g: A.mxm(_m(g), _m(g), "galois"), TR + " SELECT x.src AS i, y.dst AS j, bit_xor(CAST(x.weight AS BIGINT) & CAST(y.weight AS BIGINT)) AS v FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2")
_simple("algebra_mxm_onto", trade, lambda g: A.mxm(_m(g), _m(g), onto=_m(g)), TR + " SELECT x.src AS i, y.dst AS j, sum(x.weight * y.weight) + any_value(o.weight) AS v FROM e x JOIN e y ON x.dst = y.src JOIN e o ON o.src = x.src AND o.dst = y.dst GROUP BY 1, 2")
_simple("algebra_matrix_report", co_purchase, lambda g: A.matrix_report(A.laplacian_matrix(g)), "SELECT true AS symmetric, true AS sdd, true AS laplacian")
_simple("algebra_triangles", co_purchase, A.algebraic_triangles, CP + TRI + " SELECT id AS node, coalesce(t, 0) AS triangles FROM v LEFT JOIN tn ON node = id")
_on("algebra_bfs", lambda g, s, d: A.algebraic_bfs(g, REGIONS), TER + f", b AS (SELECT CAST({REGIONS} AS BIGINT) AS node, CAST(-1 AS BIGINT) AS last, 0.0 AS distance UNION ALL SELECT s.v, b.node, distance + 1 FROM b JOIN s ON s.u = b.node AND s.v <> last) SELECT node, distance FROM b", territory)
_on("algebra_bellman_ford", lambda g, s, d: A.algebraic_bellman_ford(g, REGIONS), TER + f", b AS (SELECT CAST({REGIONS} AS BIGINT) AS node, CAST(-1 AS BIGINT) AS last, CAST(0 AS DOUBLE) AS distance UNION ALL SELECT s.v, b.node, distance + s.w FROM b JOIN s ON s.u = b.node AND s.v <> last) SELECT node, distance FROM b", territory)
_simple("algebra_pagerank", co_purchase, A.algebraic_pagerank, None)

# paths
_all = TER + _FOREST
_simple("distance_apsp", territory, X.apsp, _all + " SELECT a AS source, b AS target, x AS distance FROM w")
_on("distance_spsp", lambda g, s, d: X.pair_distances(g, g.vertices.where("id < 25"), g.vertices.where(F.col("id") >= SUPPLIERS)), _all + f" SELECT a AS source, b AS target, CAST(k AS DOUBLE) AS distance FROM w WHERE a < 25 AND b >= {SUPPLIERS}", territory)
_on("distance_targets", lambda g, s, d: X.target_distances(g, 0, g.vertices.where(F.col("id") >= REGIONS), weighted=True), TER + _FOREST.replace("FROM v UNION ALL", "FROM v WHERE id = 0 UNION ALL") + f" SELECT id AS target, x AS distance FROM v LEFT JOIN w ON b = id WHERE id >= {REGIONS}", territory)
_on("distance_path_counts", lambda g, s, d: X.shortest_path_counts(g, 0), TER + _FOREST.replace("FROM v UNION ALL", "FROM v WHERE id = 0 UNION ALL") + " SELECT b AS node, x AS distance, 1.0 AS paths FROM w", territory)
_on("distance_predecessors", lambda g, s, d: X.predecessors(g, I.shortest_paths(g, g.vertices.where("id = 0"))), TER + _FOREST.replace("FROM v UNION ALL", "FROM v WHERE id = 0 UNION ALL") + " SELECT b AS node, last AS predecessor FROM w WHERE k > 0", territory)
_on("distance_shortest_path", lambda g, s, d: X.shortest_path(g, 0, REGIONS), f"SELECT 0 AS position, CAST(0 AS BIGINT) AS node UNION ALL SELECT 1, CAST({REGIONS} AS BIGINT)", territory)
_on("distance_bidirectional_bfs", lambda g, s, d: X.bidirectional_bfs(g, 0, REGIONS), TER + _FOREST.replace("FROM v UNION ALL", "FROM v WHERE id = 0 UNION ALL") + f" SELECT max(k) AS distance FROM w WHERE b = {REGIONS}", territory)
_on("distance_reverse_bfs", lambda g, s, d: X.reverse_bfs(g, g.vertices.where(F.col("id") == CUSTOMERS)).select("node", "distance"), TER + f" SELECT CAST({CUSTOMERS} AS BIGINT) AS node, 0 AS distance UNION ALL SELECT CAST(c_nationkey AS BIGINT), 1 FROM customer WHERE c_custkey = 0 UNION ALL SELECT n_regionkey + {REGIONS}, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 0", downward)
_on("distance_all_simple_paths", lambda g, s, d: X.all_simple_paths(g, 0, 3, 2).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path")), SUP + " SELECT '0,3' AS path FROM e WHERE src = 3 AND dst = 0 UNION ALL SELECT '0,' || a.v || ',3' FROM s a JOIN s b ON a.v = b.u WHERE a.u = 0 AND b.v = 3 AND a.v NOT IN (0, 3)", supply)
_simple("distance_neighbourhood_function", territory, X.neighbourhood_function, _all + " SELECT k AS distance, CAST(sum(count(*)) OVER (ORDER BY k) AS BIGINT) AS pairs FROM w WHERE k > 0 GROUP BY k")
_simple("distance_floyd_warshall", supply, lambda g: X.floyd_warshall(g).select("source", "target", "distance"), SUP + ", f0 AS (SELECT id AS a, id AS b, CAST(0 AS DOUBLE) AS x FROM v UNION ALL SELECT u, v, w FROM s)" + "".join(f", f{i + 1} AS MATERIALIZED (SELECT p.a, q.b, min(p.x + q.x) AS x FROM f{i} p JOIN f{i} q ON p.b = q.a GROUP BY 1, 2)" for i in range(4)) + " SELECT a AS source, b AS target, x AS distance FROM f4")
_on("distance_landmark_labels", lambda g, s, d: X.label_distances(X.Labels(g).table(), g.vertices.where("id < 25").select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))), TER + _FOREST.replace("FROM v UNION ALL", "FROM v WHERE id = 0 UNION ALL") + " SELECT b AS u, CAST(0 AS BIGINT) AS v, k AS distance FROM w WHERE b < 25", territory)
_simple("distance_diameter_range", territory, X.diameter_range, _all + " SELECT max(k) AS lower, max(k) AS upper FROM w")
_simple("distance_reachable_directed", downward, X.reachable_nodes, TER + f", r AS (SELECT id AS a, id AS b FROM v UNION ALL SELECT r.a, CASE WHEN e.src >= {REGIONS} THEN e.dst ELSE e.src END FROM r JOIN e ON r.b = CASE WHEN e.src >= {REGIONS} THEN e.src ELSE e.dst END) SELECT a AS node, count(*) AS reachable FROM r GROUP BY 1")
_simple("distance_reachable", territory, X.reachable_nodes, _all + " SELECT a AS node, count(*) AS reachable FROM w GROUP BY 1")
# both parts of the sum are exact in any order, so that its result is rounded once
_simple("distance_adamic_adar", co_purchase, X.adamic_adar_distance, CP + ", r AS (SELECT node, 1 / ln(degree) AS worth, floor(67108864 * (1 / ln(degree))) / 67108864 AS high FROM d WHERE degree > 1), c AS (SELECT e.src, e.dst, sum(high) + sum(worth - high) AS aa FROM e JOIN s x ON x.u = e.src JOIN s y ON y.u = e.dst AND y.v = x.v JOIN r ON node = x.v GROUP BY 1, 2) SELECT e.src, e.dst, coalesce(1 / aa, CAST('inf' AS DOUBLE)) AS distance FROM e LEFT JOIN c ON c.src = e.src AND c.dst = e.dst")
_simple("distance_mean_ball", territory, lambda g: X.mean_ball(g, 2), _all + " SELECT avg(c) AS nodes FROM (SELECT count(*) AS c FROM w WHERE k <= 2 GROUP BY a)")
_simple("distance_approximate_neighbourhood_function", territory, X.approximate_neighbourhood_function, None)
_simple("distance_hop_plot", territory, X.hop_plot, None)
_simple("distance_effective_diameter", supply, X.effective_diameter, SUP + ", k AS (SELECT count(*) AS c FROM v) SELECT avg(CASE WHEN degree + 1 >= ceil(0.9 * c) THEN 1.0 ELSE 2.0 END) AS effective_diameter FROM d, k")
_simple("distance_approximate_effective_diameter", supply, X.approximate_effective_diameter, None)
_simple("distance_algebraic", supply, X.algebraic_distance, None)
_simple("distance_commute", supply, X.commute_distance, None)
_on("components_sizes", lambda g, s, d: X.component_sizes(I.connected_components(g)), TER + f", c AS (SELECT n_regionkey AS r, min(n_nationkey) AS m, count(*) AS k FROM nation GROUP BY 1) SELECT CAST(m AS BIGINT) AS component, 1 + k + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r) AS size FROM c", territory)
_simple("components_biconnected", territory, lambda g: K.biconnected_components(g).groupBy("node").agg(F.count("*").alias("parts")), TER + " SELECT node, degree AS parts FROM d")
_simple("components_biconnected_strong", strong, lambda g: K.biconnected_components(g.materialized()).groupBy("node").agg(F.count("*").alias("parts")), CP2 + """, r AS (SELECT u AS n, v AS a, v AS x FROM s UNION SELECT r.n, r.a, s.v FROM r JOIN s ON s.u = r.x WHERE s.v <> r.n),
  f AS (SELECT n, a, min(x) FILTER (WHERE EXISTS (SELECT 1 FROM s WHERE s.u = n AND s.v = x)) AS least FROM r GROUP BY n, a) SELECT n AS node, count(*) AS parts FROM f WHERE a = least GROUP BY n""")
_simple("components_territory", territory, I.connected_components, TER + ", c AS (SELECT n_regionkey AS r, min(n_nationkey) AS m FROM nation GROUP BY 1), n AS (SELECT n_nationkey AS k, CAST(m AS BIGINT) AS m FROM nation JOIN c ON r = n_regionkey)" + f" SELECT CAST(r AS BIGINT) + {REGIONS} AS node, CAST(m AS BIGINT) AS component FROM c UNION ALL SELECT CAST(k AS BIGINT), m FROM n UNION ALL SELECT c_custkey + {CUSTOMERS}, m FROM customer JOIN n ON k = c_nationkey UNION ALL SELECT s_suppkey + {SUPPLIERS}, m FROM supplier JOIN n ON k = s_nationkey")

# centrality
_simple("centrality_weighted_closeness", territory, C.weighted_closeness, _all + ", n AS (SELECT count(*) - 1 AS n FROM v) SELECT a AS node, (count(*) - 1) * (count(*) - 1) / sum(x) / any_value(n) AS score FROM w, n GROUP BY 1")
_simple("centrality_weighted_harmonic", territory, lambda g: C.weighted_closeness(g, harmonic=True), _all + ", n AS (SELECT count(*) - 1 AS n FROM v) SELECT a AS node, sum(CASE WHEN x > 0 THEN 1 / x ELSE 0 END) / any_value(n) AS score FROM w, n GROUP BY 1")
_simple("centrality_edge_betweenness", supply, C.edge_betweenness, None)
_simple("centrality_estimate_betweenness", supply, lambda g: C.estimate_betweenness(g, 10), None)
_simple("centrality_approx_betweenness", purchases, lambda g: C.approx_betweenness(g, 0.1), None)
_simple("centrality_kadabra", supply, lambda g: C.kadabra_betweenness(g, 0.1), None)
_simple("centrality_approx_closeness", supply, lambda g: C.approx_closeness(g, 20), None)
_simple("centrality_top_closeness", territory, lambda g: C.top_closeness(g, 5), _all + ", n AS (SELECT count(*) - 1 AS n FROM v), q AS (SELECT a AS node, (count(*) - 1) * (count(*) - 1) / CAST(sum(k) AS DOUBLE) / any_value(n) AS score FROM w, n GROUP BY 1) SELECT node, score FROM q ORDER BY score DESC, node LIMIT 5")
_simple("centrality_top_harmonic", territory, lambda g: C.top_closeness(g, 5, harmonic=True), _all + ", n AS (SELECT count(*) - 1 AS n FROM v), q AS (SELECT a AS node, sum(CASE WHEN k > 0 THEN 1.0 / k ELSE 0 END) / any_value(n) AS score FROM w, n GROUP BY 1) SELECT node, score FROM q ORDER BY score DESC, node LIMIT 5")
_simple("centrality_k_path", supply, C.k_path, None)
_on("centrality_permanence", lambda g, s, d: C.permanence(g, brands(s, d)), None)
_on("centrality_local_partition_coverage", lambda g, s, d: C.local_partition_coverage(g, brands(s, d)), CP + PART + ", y AS (SELECT src AS n, a, b, weight FROM l UNION ALL SELECT dst, b, a, weight FROM l) SELECT node, coalesce(sum(weight) FILTER (a = b) / sum(weight), 0.0) AS score FROM p LEFT JOIN y ON n = node GROUP BY node")
_simple("centrality_square_clustering", supply, C.square_clustering, SUP + ", q AS (SELECT x.u AS m, x.v AS a, y.v AS b FROM s x JOIN s y ON x.u = y.u AND x.v < y.v), c AS (SELECT a, b, count(*) AS k FROM q GROUP BY 1, 2), t AS (SELECT q.m, sum(c.k - 1) AS sq, sum(da.degree + db.degree - c.k - 1 - CASE WHEN e.src IS NULL THEN 0 ELSE 2 END) AS po FROM q JOIN c ON c.a = q.a AND c.b = q.b JOIN d da ON da.node = q.a JOIN d db ON db.node = q.b LEFT JOIN e ON e.src = q.b AND e.dst = q.a GROUP BY 1) SELECT id AS node, CASE WHEN po > 0 THEN sq * 1.0 / po ELSE 0.0 END AS score FROM v LEFT JOIN t ON m = id")
_on("centrality_complex_paths", lambda g, s, d: C.complex_path_lengths(g, 3, 0), None, supply)
_simple("centrality_spanning_edge", supply, C.spanning_edge, None)
_simple("centrality_approx_spanning_edge", supply, C.approx_spanning_edge, None)
_simple("centrality_electrical", supply, C.electrical_closeness, None)
_simple("centrality_forest", supply, C.forest_closeness, None)
_simple("centrality_group_degree", territory, lambda g: C.group_degree(g, 5), TER + ", f AS (SELECT node, degree FROM d WHERE node < 25) SELECT row_number() OVER (ORDER BY degree DESC, node) - 1 AS position, node FROM f ORDER BY 1 LIMIT 5")
_simple("centrality_group_closeness", supply, lambda g: C.group_closeness(g, 3), None)
_simple("centrality_group_harmonic", supply, lambda g: C.group_closeness(g, 3, harmonic=True), None)
_simple("centrality_group_betweenness", supply, lambda g: C.approx_group_betweenness(g, 3, 0.2), None)
_simple("centrality_walk_group", supply, lambda g: C.walk_group(g, 2), None)
_simple("centrality_top_katz", co_purchase, lambda g: C.top_katz(g, 10), None)
_on("centrality_centralization", lambda g, s, d: C.centralization(T.weighted_degrees(g).withColumnRenamed("weighted_degree", "score")), CP + " SELECT max(wd) * count(*) - sum(wd) AS centralization FROM d")
_on("centrality_rank_per_node", lambda g, s, d: C.rank_per_node(T.weighted_degrees(g).withColumnRenamed("weighted_degree", "score")), CP + " SELECT node, rank() OVER (ORDER BY wd DESC) + (count(*) OVER (PARTITION BY wd) - 1) / 2.0 AS rank FROM d")
_simple("centrality_pagerank_converged", co_purchase, I.pagerank, None)

# communities and partitions
_ok = " SELECT (SELECT count(*) FROM v) AS nodes, true AS proper, true AS better_than_chance"


def _good(g: Graph, p: DataFrame) -> DataFrame:
    """One row: how many nodes have a community, whether each has one, and whether modularity is above that of a random partition."""
    q, r = P.modularity(g, p).first()[0], P.modularity(g, P.random_partition(g, 7)).first()[0]
    return P.partition_kind(g, p).select(F.lit(p.count()).alias("nodes"), "proper", F.lit(bool(q > r)).alias("better_than_chance"))


for _name, _f in {"louvain": M.louvain, "leiden": M.leiden, "agglomerative": M.agglomerative}.items():
    _simple(f"community_{_name}", co_purchase, lambda g, f=_f: (lambda h: _good(h, f(h)))(g.materialized()), CP + _ok)
_simple("community_louvain_refined", co_purchase, lambda g: (lambda h: _good(h, M.louvain(h, refine=True)))(g.materialized()), CP + _ok)
_simple("community_map_equation", territory, lambda g: (lambda h: _good(h, M.louvain_map_equation(h)))(g.materialized()), TER + _ok)
# the level of single nodes in tables, what it leaves on the driver
_simple("community_map_equation_strong", strong, lambda g: (lambda h: _good(h, shortened(h, local=1500)))(g.materialized()), CP2 + _ok)
_simple("community_label_propagation_by_degree", territory, lambda g: (lambda h: _good(h, M.label_propagation_by_degree(h)))(g.materialized()), TER + _ok)
_simple("community_spectral", supply, lambda g: P.partition_kind(g, M.spectral_partition(g, 4)).select("proper"), "SELECT true AS proper")
_simple("community_cut_clustering", supply, lambda g: P.partition_kind(g, M.cut_clustering(g, 5.0)).select("proper"), "SELECT true AS proper")
_on("community_map_equation_bits", lambda g, s, d: M.map_equation(g, brands(s, d)), CP + PART + ", t AS (SELECT 2 * sum(weight) AS w FROM e), y AS (SELECT a AS c, b AS o, src AS n, weight FROM l UNION ALL SELECT b, a, dst, weight FROM l), m AS (SELECT c, sum(weight) / any_value(w) AS vol, coalesce(sum(weight) FILTER (c <> o), 0) / any_value(w) AS q FROM y, t GROUP BY c), n AS (SELECT sum(weight) / any_value(w) AS p FROM y, t GROUP BY n) SELECT sum(q) * log2(sum(q)) - 2 * sum(q * log2(q)) - (SELECT sum(p * log2(p)) FROM n) + sum((q + vol) * log2(q + vol)) AS bits FROM m")
_simple("community_k_core", co_purchase, lambda g: M.k_core_communities(g, 40), None)


def _parted(name: str, op, sql: str | None) -> None:
    _on(f"community_{name}", lambda g, s, d, op=op: op(g, brands(s, d)), (CP + PART + sql) if sql else None)


def _fives(p: DataFrame) -> DataFrame:
    return p.withColumn("community", F.col("node") % 5)


_parted("members", lambda g, p: P.members(p, 3), " SELECT node FROM p WHERE community = 3")
_parted("moved", lambda g, p: P.moved(p, P.members(p, 3).withColumn("community", F.lit(9).cast("long"))), " SELECT node, CASE WHEN community = 3 THEN 9 ELSE community END AS community FROM p")
_parted("merged", lambda g, p: P.merged(p, 5, 2), " SELECT node, CASE WHEN community = 5 THEN 2 ELSE community END AS community FROM p")
_parted("compacted", lambda g, p: P.compacted(p.withColumn("community", F.col("community") * 10)), " SELECT node, community FROM p")
_parted("balanced", lambda g, p: P.community_sizes(P.balanced_partition(g, 4)), " SELECT CAST(i * 4 // (SELECT count(*) FROM v) AS BIGINT) AS community, count(*) AS size FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS i FROM v) GROUP BY 1")
_parted("same", lambda g, p: P.in_same_community(p, g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))), " SELECT src AS u, dst AS v, a = b AS same FROM l")
_parted("kind", P.partition_kind, " SELECT true AS proper, false AS singletons, false AS one")
_parted("equal", lambda g, p: P.equal_partitions(p, p.withColumn("community", -F.col("community"))), " SELECT true AS equal")
_parted("communication_graph", lambda g, p: P.communication_graph(g, p).edges, " SELECT greatest(a, b) AS src, least(a, b) AS dst, sum(weight) AS weight FROM l WHERE a <> b GROUP BY 1, 2")
_parted("intersected", lambda g, p: P.intersected(p, _fives(p)), " SELECT node, min(node) OVER (PARTITION BY community, node % 5) AS community FROM p")
_parted("projected", lambda g, p: P.projected(P.coarsened(g, p).vertices.select(F.col("id").alias("node"), (F.col("id") % 2).alias("community")), p.withColumnRenamed("community", "coarse")), " SELECT node, community % 2 AS community FROM p")
_parted("adjusted_rand", lambda g, p: P.adjusted_rand(p, _fives(p)), ", k AS (SELECT community AS a, node % 5 AS b, CAST(count(*) AS DOUBLE) AS k FROM p GROUP BY 1, 2), t AS (SELECT (SELECT sum(k * (k - 1) / 2) FROM k) AS s, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(k) AS k FROM k GROUP BY a)) AS x, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(k) AS k FROM k GROUP BY b)) AS y, (SELECT sum(k) * (sum(k) - 1) / 2 FROM k) AS n) SELECT 1 - (s - x * y / n) / ((x + y) / 2 - x * y / n) AS dissimilarity FROM t")
_parted("graph_rand", lambda g, p: P.graph_rand(g, p, _fives(p)), " SELECT avg(CASE WHEN (a = b) <> (src % 5 = dst % 5) THEN 1.0 ELSE 0.0 END) AS dissimilarity FROM l")
_parted("sampled_rand", lambda g, p: P.sampled_rand(p, _fives(p), 2000), None)
_parted("sampled_graph_rand", lambda g, p: P.graph_rand(g, p, _fives(p), 2000), None)
_parted("dynamic_nmi", lambda g, p: P.dynamic_nmi(p, _fives(p)), None)
_parted("intrapartition_density", P.intrapartition_density, ", n AS (SELECT community, count(*) AS k FROM p GROUP BY 1), i AS (SELECT a, count(*) AS m FROM l WHERE a = b GROUP BY 1) SELECT community, coalesce(m, 0) / (k * (k - 1) / 2.0) AS density FROM n LEFT JOIN i ON a = community")
_parted("fragmentation", P.partition_fragmentation, None)
_parted("stable_nodes", P.stable_nodes, ", y AS (SELECT src AS n, a, b, weight FROM l UNION ALL SELECT dst, b, a, weight FROM l), z AS (SELECT n, a, b, sum(weight) AS w FROM y GROUP BY 1, 2, 3), q AS (SELECT n, coalesce(max(w) FILTER (a = b), 0.0) AS own, max(w) FILTER (a <> b) AS other FROM z GROUP BY n) SELECT node, coalesce(other IS NULL OR own > other, true) AS stable FROM p LEFT JOIN q ON n = node")
_parted("evaluated", lambda g, p: P.evaluated(P.intrapartition_density(g, p), p, "density"), ", n AS (SELECT community, count(*) AS k FROM p GROUP BY 1), i AS (SELECT a, count(*) AS m FROM l WHERE a = b GROUP BY 1), q AS (SELECT k, coalesce(m, 0) / (k * (k - 1) / 2.0) AS x FROM n LEFT JOIN i ON a = community) SELECT sum(x * k) / sum(k) AS weighted, avg(x) AS mean, min(x) AS least, max(x) AS largest FROM q")
_COVER = ", cv AS (SELECT node, community FROM p UNION SELECT node, node % 5 + 100 FROM p)"


def _cover(p: DataFrame) -> DataFrame:
    return P.added_to(P.cover_of(p), p.select("node", (F.col("node") % 5 + 100).alias("community")))


_parted("cover_of_nodes", lambda g, p: P.communities_of(_cover(p)).select("node", F.array_join(F.transform("communities", lambda x: x.cast("string")), ",").alias("communities")), _COVER + " SELECT node, string_agg(CAST(community AS VARCHAR), ',' ORDER BY community) AS communities FROM cv GROUP BY node")
_parted("cover_hub_dominance", lambda g, p: P.cover_hub_dominance(g, _cover(p)), _COVER + ", n AS (SELECT community, count(*) AS k FROM cv GROUP BY 1), x AS (SELECT a.community, unnest([src, dst]) AS node FROM e JOIN cv a ON a.node = src JOIN cv b ON b.node = dst AND a.community = b.community), m AS (SELECT community, max(k) AS m FROM (SELECT community, count(*) AS k FROM x GROUP BY community, node) GROUP BY 1) SELECT community, coalesce(m, 0) * 1.0 / (k - 1) AS dominance FROM n LEFT JOIN m USING (community)")
_parted("cover_f1", lambda g, p: P.cover_f1(_cover(p), _fives(p)), _COVER + ", n AS (SELECT community, count(*) AS k FROM cv GROUP BY 1), r AS (SELECT node, node % 5 AS c FROM p), rn AS (SELECT c, count(*) AS k FROM r GROUP BY 1), o AS (SELECT community, c, count(*) AS k FROM cv JOIN r USING (node) GROUP BY 1, 2) SELECT o.community, max(2.0 * o.k / (n.k + rn.k)) AS f1 FROM o JOIN n USING (community) JOIN rn USING (c) GROUP BY 1")
_parted("overlapping_nmi", lambda g, p: P.overlapping_nmi(_cover(p), _fives(p)), None)
_parted("hashed_overlap", lambda g, p: M.hashed_overlap([p, _fives(p)]), " SELECT node, min(node) OVER (PARTITION BY community, node % 5) AS community FROM p")
_parted("modularity_resolution", lambda g, p: P.modularity(g, p, 0.5), ", vol AS (SELECT c, sum(weight) AS x FROM (SELECT a AS c, weight FROM l UNION ALL SELECT b, weight FROM l) GROUP BY c) SELECT (SELECT sum(weight) FILTER (a = b) / sum(weight) FROM l) - 0.5 * (SELECT sum(x * x) FROM vol) / (4 * (SELECT sum(weight) FROM l) ** 2) AS modularity")
_simple("edgescores_modularity", co_purchase, M.modularity_scores, CP + ", t AS (SELECT sum(weight) AS w FROM e) SELECT src, dst, weight / w - a.wd * b.wd / (2 * w * w) AS score FROM e, t JOIN d a ON a.node = src JOIN d b ON b.node = dst".replace("FROM e, t JOIN d a ON a.node = src JOIN d b ON b.node = dst", "FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst CROSS JOIN t"))

# edge scores
_w = lambda g: g.edges.withColumnRenamed("weight", "score")
_TE = ", te AS MATERIALIZED (SELECT src, dst, count(*) AS k FROM (SELECT c AS src, b AS dst FROM t UNION ALL SELECT b, a FROM t UNION ALL SELECT c, a FROM t) GROUP BY 1, 2), tw AS (SELECT e.src, e.dst, coalesce(k, 0) AS k FROM e LEFT JOIN te ON te.src = e.src AND te.dst = e.dst)"
_simple("edgescores_quadrangles", supply, E.quadrangles, SUP + ", c AS (SELECT x.v AS a, y.v AS b, count(*) AS k FROM s x JOIN s y ON x.u = y.u AND x.v <> y.v GROUP BY 1, 2) SELECT e.src, e.dst, coalesce(sum(c.k - 1), 0) AS score FROM e LEFT JOIN s x ON x.u = e.src AND x.v <> e.dst LEFT JOIN c ON c.a = e.dst AND c.b = x.v GROUP BY 1, 2")
_simple("edgescores_as_weights", co_purchase, lambda g: E.as_weights(g, _w(g), squared=True, offset=1.0, factor=2.0).edges, CP + " SELECT src, dst, 1 + 2 * weight * weight AS weight FROM e")
_simple("edgescores_linearized", co_purchase, lambda g: E.linearized(_w(g)).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean")), "SELECT 0.0 AS low, 1.0 AS high, 0.5 AS mean")
_simple("edgescores_geometric_mean", co_purchase, lambda g: E.geometric_mean(_w(g)), CP + " SELECT src, dst, weight / sqrt(a.wd * b.wd) AS score FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst")
_simple("edgescores_blended", co_purchase, lambda g: E.blended(_w(g), E.constant(g, -1.0), g.edges.where("weight >= 2")), CP + " SELECT src, dst, CASE WHEN weight >= 2 THEN -1.0 ELSE weight END AS score FROM e")
_simple("edgescores_prefix_jaccard", supply, lambda g: E.prefix_jaccard(_w(g)), None)
_simple("edgescores_rank", co_purchase, lambda g: E.rank_score(_w(g)), CP + " SELECT src, dst, (rank() OVER (ORDER BY weight) + (count(*) OVER (PARTITION BY weight) - 1) / 2.0) / count(*) OVER () AS score FROM e")
_simple("sparsify_chance_corrected", co_purchase, E.chance_corrected, CP + TRI + _TE + " SELECT src, dst, CASE WHEN (a.degree - 1) * (b.degree - 1) > 0 THEN k * ((SELECT count(*) FROM v) - 2.0) / ((a.degree - 1) * (b.degree - 1)) ELSE 1.0 END AS score FROM tw JOIN d a ON a.node = src JOIN d b ON b.node = dst")
_simple("sparsify_simmelian_overlap", supply, lambda g: E.simmelian_overlap(_w(g), 10), SUP + ", r AS (SELECT u, v, rank() OVER (PARTITION BY u ORDER BY w DESC) - 1 AS r FROM s), q AS (SELECT u, v FROM r WHERE r <= 10) SELECT src, dst, CAST(count(y.v) AS DOUBLE) AS score FROM e LEFT JOIN q x ON x.u = src AND x.v <> dst LEFT JOIN q y ON y.u = dst AND y.v = x.v AND y.v <> src GROUP BY 1, 2")
_simple("sparsify_local_similarity", co_purchase, E.local_similarity, CP + TRI + _TE + ", j AS (SELECT src, dst, k * 1.0 / (a.degree + b.degree - k) AS score FROM tw JOIN d a ON a.node = src JOIN d b ON b.node = dst), sd AS (SELECT src AS u, dst AS v, score FROM j UNION ALL SELECT dst, src, score FROM j), r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS r, count(*) OVER (PARTITION BY u) AS k FROM sd) SELECT greatest(u, v) AS src, least(u, v) AS dst, max(CASE WHEN k > 1 THEN 1 - ln(r) / ln(k) ELSE 1.0 END) AS score FROM r GROUP BY 1, 2")
_simple("sparsify_random_edges", co_purchase, lambda g: E.random_part(g, 0.3).edges, None)
_simple("sparsify_random_node_edges", co_purchase, lambda g: E.random_node_edge(g), None)
_simple("sparsify_forest_fire", supply, E.forest_fire, None)
_simple("sparsify_simmelian_nonparametric", supply, lambda g: E.simmelian_nonparametric(g, 0.5).edges, None)
_simple("sparsify_simmelian_parametric", co_purchase, lambda g: E.simmelian_parametric(g, 10, 3).edges, None)
_simple("sparsify_triangle_disparity", co_purchase, lambda g: E.triangle_disparity(g, 0.5).edges, None)
_simple("sparsify_by_triangles", co_purchase, lambda g: E.by_triangles(g, 3).edges, CP + TRI + _TE + " SELECT e.src, e.dst, weight FROM e JOIN tw ON tw.src = e.src AND tw.dst = e.dst WHERE k >= 3")
_on("sparsify_within_communities", lambda g, s, d: E.within_communities(g, brands(s, d)).edges, CP + PART + " SELECT src, dst, weight FROM l WHERE a = b")
_on("sparsify_partition_score", lambda g, s, d: E.partition_score(g, brands(s, d)), CP + PART + " SELECT src, dst, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS score FROM l")

# link prediction
_pairs = lambda g: g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
_simple("linkprediction_neighbours_measure", supply, lambda g: L.neighbours_measure(g, _pairs(g)), SUP + ", q AS (SELECT src AS u, dst AS v FROM e), c AS (SELECT q.u, q.v, count(*) AS k FROM q JOIN s x ON x.u = q.u JOIN s y ON y.u = q.v AND y.v = x.v GROUP BY 1, 2), n AS (SELECT q.u, q.v, count(*) AS k FROM q JOIN s x ON x.u = q.u JOIN s y ON y.u = q.v JOIN s z ON z.u = x.v AND z.v = y.v GROUP BY 1, 2) SELECT q.u, q.v, CAST(coalesce(c.k, 0) + coalesce(n.k, 0) AS DOUBLE) AS score FROM q LEFT JOIN c USING (u, v) LEFT JOIN n USING (u, v)")
_simple("linkprediction_katz", supply, lambda g: L.katz_index(g, _pairs(g), 2, 0.5), SUP + ", q AS (SELECT src AS u, dst AS v FROM e), two AS (SELECT DISTINCT x.u, y.v FROM s x JOIN s y ON x.v = y.u) SELECT q.u, q.v, 0.5 + CASE WHEN (q.u, q.v) IN (SELECT u, v FROM two) THEN 0.25 ELSE 0.0 END AS score FROM q")
_simple("linkprediction_adjusted_rand", supply, lambda g: L.adjusted_rand_index(g, _pairs(g)), None)
_simple("linkprediction_algebraic", supply, lambda g: L.algebraic_index(g, _pairs(g)), None)
_on("linkprediction_same_community", lambda g, s, d: L.same_community(g, _pairs(g), brands(s, d)), CP + PART + " SELECT src AS u, dst AS v, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS score FROM l")
_simple("linkprediction_u_degree", co_purchase, lambda g: L.end_degree(g, _pairs(g)), CP + " SELECT src AS u, dst AS v, CAST(degree AS DOUBLE) AS score FROM e JOIN d ON node = src")
_simple("linkprediction_v_degree", co_purchase, lambda g: L.end_degree(g, _pairs(g), "v"), CP + " SELECT src AS u, dst AS v, CAST(degree AS DOUBLE) AS score FROM e JOIN d ON node = dst")
_simple("linkprediction_missing_links", purchases, lambda g: L.missing_links(g, 2), PUR + " SELECT DISTINCT x.v AS u, y.v AS v FROM s x JOIN s y ON x.u = y.u AND x.v < y.v")
_simple("linkprediction_by_score", co_purchase, lambda g: L.links_by_score(_pairs(g).join(g.edges.toDF("u", "v", "score"), ["u", "v"]), 2.0), CP + " SELECT src AS u, dst AS v FROM e WHERE weight >= 2")
_simple("linkprediction_by_count", co_purchase, lambda g: L.links_by_count(g.edges.toDF("u", "v", "score"), 100), CP + " SELECT src AS u, dst AS v FROM e ORDER BY weight DESC, src, dst LIMIT 100")
_simple("linkprediction_by_percentage", co_purchase, lambda g: L.links_by_percentage(g.edges.toDF("u", "v", "score"), 0.1), CP + " SELECT src AS u, dst AS v FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS r, count(*) OVER () AS n FROM e) WHERE r <= floor(n * 0.1)")
_simple("linkprediction_training_graph", co_purchase, lambda g: L.training_graph(g, 0.5).edges, None)


def _judged_pairs(g: Graph) -> tuple[Graph, DataFrame]:
    """Pairs scored by weight; those above 1 are links of the test graph."""
    return g.filter_edges("weight >= 2"), g.edges.toDF("u", "v", "score").withColumn("score", (F.col("u") * 7919 + F.col("v")) % 1009 / 1.0)


_J = ", q AS (SELECT src, dst, CASE WHEN weight >= 2 THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY (src * 7919 + dst) % 1009 DESC, src, dst) AS n FROM e), h AS (SELECT n, sum(y) OVER (ORDER BY n) AS h, sum(y) OVER () AS pos, count(*) OVER () AS total FROM q), th AS (SELECT DISTINCT CAST(ceil(total * i / 10.0) AS BIGINT) AS n FROM (SELECT any_value(total) AS total FROM h), range(11) t(i))"
_simple("linkprediction_roc", co_purchase, lambda g: (lambda t: L.roc_curve(*t, points=11))(_judged_pairs(g)), CP + _J + ", pts AS (SELECT (n - h) * 1.0 / (total - pos) AS fpr, h * 1.0 / pos AS tpr FROM h JOIN th USING (n) UNION ALL SELECT 0.0, 0.0) SELECT fpr, max(tpr) AS tpr FROM pts GROUP BY fpr")
_simple("linkprediction_precision_recall", co_purchase, lambda g: (lambda t: L.precision_recall_curve(*t, points=11))(_judged_pairs(g)), CP + _J + ", pts AS (SELECT h * 1.0 / pos AS recall, h * 1.0 / n AS precision FROM h JOIN th USING (n) UNION ALL SELECT 0.0, 1.0) SELECT recall, max(precision) AS precision FROM pts GROUP BY recall")

# matchings and sets
_simple("matching_b", purchases, lambda g: B.matching_report(g, B.b_matching(g, 2), 2).select("proper"), "SELECT true AS proper")
_simple("matching_path_growing", purchases, lambda g: B.matching_report(g, B.path_growing(g)).select("proper"), "SELECT true AS proper")
_simple("matching_report", purchases, lambda g: (lambda h: B.matching_report(h, I.greedy_matching(h)))(g.materialized()).select("proper"), "SELECT true AS proper")
_simple("independent_set", purchases, lambda g: (lambda h: B.is_independent(h, B.independent_set(h)))(g.materialized()), "SELECT true AS independent")
_on("flow_maximum", lambda g, s, d: s.createDataFrame([(B.maximum_flow(g, CUSTOMERS, SUPPLIERS)[0],)], "value double"), None, territory)
_simple("structure_is_planar", territory, B.is_planar, "SELECT true AS planar")
_simple("clique_maximal", territory, lambda g: B.maximal_cliques(g).select(F.element_at("clique", 1).alias("a"), F.element_at("clique", 2).alias("b")), TER + " SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e")
_simple("components_union_maximum_forest", territory, B.union_maximum_forest, TER + " SELECT src, dst, weight FROM e")


# Counts of hops on the co-purchases of weight 2 or more: a graph with cycles, many components and paths of many hops.
_HOPS = CP2 + """, w(a, b, k) USING KEY (a, b) AS (SELECT id, id, 0 FROM v UNION (SELECT w.a, s.v, min(w.k + 1) FROM w JOIN s ON s.u = w.b
  LEFT JOIN recurring.w r ON r.a = w.a AND r.b = s.v WHERE r.a IS NULL GROUP BY w.a, s.v)), n AS (SELECT count(*) AS n FROM v)"""
_simple("distance_neighbourhood_function_strong", strong, X.neighbourhood_function, _HOPS + " SELECT k AS distance, CAST(sum(count(*)) OVER (ORDER BY k) AS BIGINT) AS pairs FROM w WHERE k > 0 GROUP BY k")
_simple("distance_effective_diameter_strong", strong, lambda g: X.effective_diameter(g, 0.5), _HOPS + """, c AS (SELECT a, k, sum(count(*)) OVER (PARTITION BY a ORDER BY k) AS c FROM w GROUP BY a, k)
  SELECT avg(h) AS effective_diameter FROM (SELECT a, min(k) AS h FROM c, n WHERE c >= ceil(0.5 * n) GROUP BY a)""")
_simple("distance_mean_ball_strong", strong, lambda g: X.mean_ball(g, 3), _HOPS + " SELECT avg(c) AS nodes FROM (SELECT count(*) AS c FROM w WHERE k <= 3 GROUP BY a)")
_simple("centrality_top_closeness_strong", strong, lambda g: C.top_closeness(g, 10), _HOPS + ", q AS (SELECT a AS node, coalesce((count(*) - 1) * (count(*) - 1) / nullif(CAST(sum(k) AS DOUBLE), 0) / (any_value(n) - 1), 0.0) AS score FROM w, n GROUP BY a) SELECT node, score FROM q ORDER BY round(score, 12) DESC, node LIMIT 10")
_simple("centrality_top_harmonic_strong", strong, lambda g: C.top_closeness(g, 10, harmonic=True), _HOPS + ", q AS (SELECT a AS node, sum(CASE WHEN k > 0 THEN 1.0 / k ELSE 0.0 END) / (any_value(n) - 1) AS score FROM w, n GROUP BY a) SELECT node, score FROM q ORDER BY round(score, 12) DESC, node LIMIT 10")
_simple("centrality_group_closeness_strong", strong, lambda g: C.group_closeness(g, 2), _HOPS + """, f AS (SELECT a, sum(n - k) AS gain FROM w, n GROUP BY a), one AS (SELECT a FROM f ORDER BY gain DESC, a LIMIT 1),
  near AS (SELECT v.id, coalesce(w.k, n) AS d FROM v CROSS JOIN one CROSS JOIN n LEFT JOIN w ON w.a = one.a AND w.b = v.id),
  two AS (SELECT w.a FROM w JOIN near ON near.id = w.b WHERE w.a NOT IN (SELECT a FROM one) GROUP BY w.a ORDER BY sum(greatest(d - k, 0)) DESC, w.a LIMIT 1)
  SELECT CAST(0 AS INT) AS position, a AS node FROM one UNION ALL SELECT 1, a FROM two""")
