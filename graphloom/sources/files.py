"""Graph files: edge lists, METIS, SNAP and COO in; edge lists and METIS rows out. Parsing stays in Spark's text reader and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.numbering import numbered
from graphloom.plans.scratch import materialize


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(no, value): lines numbered from 0 in file order, files in order of their names, without one task that sees all.

    A line's number within its file is the number of line feeds before it: splits of a file are
    told apart by where they start, and each counts its own lines.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = materialize(rows, "lines")
    sizes = rows.groupBy("f", "b").agg(F.count("*").alias("k"), F.min("i").alias("low"))  # one row per split
    before = F.sum("k").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1))
    base = F.broadcast(sizes.select("f", "b", "low", F.coalesce(before, F.lit(0)).alias("base")))
    return rows.join(base, ["f", "b"]).select((F.col("base") + F.col("i") - F.col("low")).alias("no"), "value")


def read_edge_list(spark: SparkSession, path: str, separator: str = r"\s+", first_node: int = 0, comment: str = "#", directed: bool = False) -> Graph:
    """`u SEP v [SEP w]` lines; of parallel edges the first in the file stays."""
    lines = lines_in_order(spark, path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    p = F.split(F.trim("value"), separator)
    e = lines.select("no", (p[0].try_cast("long") - first_node).alias("src"), (p[1].try_cast("long") - first_node).alias("dst"), F.coalesce(F.get(p, 2).try_cast("double"), F.lit(1.0)).alias("weight"))
    return Graph.from_edges(e, directed)


def read_named_edge_list(spark: SparkSession, path: str, separator: str = r"\s+", comment: str = "#", directed: bool = False) -> tuple[Graph, DataFrame]:
    """The same with names instead of numbers: nodes are numbered by first mention, given as (name, id)."""
    p = F.split(F.trim("value"), separator)
    t = lines_in_order(spark, path).where(~F.col("value").startswith(comment) & (F.trim("value") != "")).select("no", p[0].alias("a"), p[1].alias("b"), F.coalesce(F.get(p, 2).try_cast("double"), F.lit(1.0)).alias("weight"))
    first = t.select("no", F.posexplode(F.array("a", "b")).alias("k", "name")).groupBy("name").agg(F.min(F.struct("no", "k")).alias("at"))
    ids = numbered(first.select("name", F.col("at.no").alias("no"), F.col("at.k").alias("k")), "no", "k", name="id").select("name", "id")
    e = t.join(ids.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b")
    return Graph.from_edges(e.select("no", "src", "dst", "weight"), directed, vertices=ids.select("id")), ids


def read_snap(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    return read_edge_list(spark, path, directed=directed)


def read_metis(spark: SparkSession, path: str) -> Graph:
    """Header `n m [fmt [ncon]]`, then the 1-based neighbours of each node; fmt % 10 == 1: with weights; fmt / 10 % 10 == 1: node weights first."""
    kept = numbered(lines_in_order(spark, path).where("NOT startswith(value, '%')"), "no", name="k").select(F.col("k").alias("no"), F.col("value").alias("line"))
    lines = materialize(kept, "metis")
    head = [int(x) for x in lines.where("no = 0").first()["line"].split()]
    n, fmt = head[0], head[2] if len(head) > 2 else 0
    skip = (head[3] if len(head) > 3 else 1) if fmt // 10 % 10 == 1 else 0
    toks = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = lines.where((F.col("no") > 0) & (F.col("no") <= n)).select((F.col("no") - 1).try_cast("long").alias("src"), F.slice(toks, F.lit(skip + 1), F.greatest(F.size(toks) - skip, F.lit(0))).alias("t"))
    step = 2 if fmt % 10 == 1 else 1
    cells = rows.select("src", F.posexplode("t").alias("k", "x"), "t").where(F.col("k") % step == 0)
    w = F.element_at("t", F.col("k") + 2).try_cast("double") if step == 2 else F.lit(1.0)
    return Graph.from_edges(cells.select("src", (F.col("x").try_cast("long") - 1).alias("dst"), w.alias("weight")), vertices=spark.range(n))


def write_edge_list(g: Graph, path: str, separator: str = "\t", first_node: int = 0, both: bool = False) -> None:
    """A line per edge; both: undirected ones also the other way round."""
    e = g.arcs().select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight")) if both else g.edges
    cols = [(F.col("src") + first_node).cast("string"), (F.col("dst") + first_node).cast("string"), F.col("weight").cast("string")]
    e.select(F.concat_ws(separator, *cols).alias("value")).write.text(path)


def metis_rows(g: Graph) -> DataFrame:
    """(node, line) of a METIS body; ids must be 0 to n - 1."""
    nbrs = g.adjacency().select(F.col("src").alias("id"), F.array_join(F.transform("nbrs", lambda x: (x + 1).cast("string")), " ").alias("line"))
    return g.vertices.join(nbrs, "id", "left").select(F.col("id").alias("node"), F.coalesce("line", F.lit("")).alias("line"))


def from_coo(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """Parquet with src, dst and perhaps weight."""
    return Graph.from_edges(spark.read.parquet(path), directed)
