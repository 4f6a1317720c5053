"""Graphs as DataFrames: vertices(id) and edges(src, dst, weight); undirected edges are stored once, src >= dst."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.spread import spread


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None, multi: str = "discard") -> Graph:
        """edges(src, dst[, weight][, no]); of parallel edges, multi: discard keeps the first by no (without no, as minimum), minimum the least weight, sum adds them up, keep leaves them."""
        w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        no = [F.col("no")] if "no" in edges.columns else []
        e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("weight"), *no)
        if not directed:
            e = e.withColumns({"src": F.greatest("src", "dst"), "dst": F.least("src", "dst")})
        if multi != "keep":
            one = F.sum("weight") if multi == "sum" else F.min_by("weight", "no") if multi == "discard" and no else F.min("weight")
            e = e.groupBy("src", "dst").agg(one.alias("weight"))
        e = e.select("src", "dst", "weight")
        v = vertices.select(F.col("id").cast("long")).distinct() if vertices is not None else e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        return cls(v, e, directed)

    def arcs(self) -> DataFrame:
        """(u, v, w): both directions of undirected edges, loops once."""
        out = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("w"))
        if self.directed:
            return out
        return out.union(self.edges.where("src <> dst").select("dst", "src", "weight"))

    def materialized(self) -> Graph:
        """The same with edges written once, so that operators that read them again don't build them again."""
        from graphloom.plans.scratch import materialize

        return self if hasattr(self.edges, "_scratch_path") else Graph(self.vertices, materialize(self.edges, "edges"), self.directed)

    def adjacency(self) -> DataFrame:
        """(src, nbrs, ws), neighbours sorted: one row of a compressed sparse row matrix per vertex with edges."""
        pairs = F.sort_array(F.collect_list(F.struct("v", "w")))
        return self.arcs().groupBy(F.col("u").alias("src")).agg(pairs.alias("p")).select("src", F.col("p.v").alias("nbrs"), F.col("p.w").alias("ws"))

    def filter_edges(self, condition: str) -> Graph:
        return Graph(self.vertices, self.edges.where(condition), self.directed)


def shared_orders(li: DataFrame, key: str) -> DataFrame:
    """(l_orderkey, src, dst), src > dst, of values of key in one order; once for each pair of rows."""
    k = li.count()
    li = spread(li, k, "l_orderkey")
    pairs = li.withColumnRenamed(key, "src").join(li.withColumnRenamed(key, "dst").select("l_orderkey", "dst"), "l_orderkey").where("src > dst")
    return spread(pairs, 2 * k, "src", "dst")  # orders of four rows have six pairs


def co_purchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought in one order, weighted by how often."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    e = shared_orders(li, "l_partkey").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return Graph(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id")), e.select(F.col("src").cast("long"), F.col("dst").cast("long"), "weight"))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: customer nation to supplier nation, weighted by lineitems."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    e = rows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return Graph(t["nation"].select(F.col("n_nationkey").cast("long").alias("id")), e, directed=True)


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and their regions, regions numbered from 1000: a forest."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return Graph.from_edges(n.select((F.col("n_regionkey") + 1000).alias("src"), F.col("n_nationkey").alias("dst")))
