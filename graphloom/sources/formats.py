"""More graph, matrix, partition, cover and event files. Line formats are read by Spark's text reader and numbered in file order without a single task; nested ones (GML, GEXF, GraphML) are small documents and are parsed on the driver."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.numbering import numbered
from graphloom.sources.files import lines_in_order

#: Bytes of a nested document at most.
MAX_DOCUMENT = 256 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(no, value): the lines of a file in order, from 0."""
    return lines_in_order(spark, path)


def _document(spark: SparkSession, path: str) -> str:
    """The text of a file, or of a folder's files in order of their names."""
    files = spark.read.format("binaryFile").load(path)
    if (files.agg(F.sum("length")).first()[0] or 0) > MAX_DOCUMENT:
        raise ValueError(f"documents of more than {MAX_DOCUMENT} bytes are not read")
    return b"".join(bytes(r["content"]) for r in sorted(files.select("path", "content").collect())).decode()


def _write_lines(df: DataFrame, path: str) -> None:
    """df (no, value) as one file per sorted range, in order."""
    df.repartitionByRange("no").sortWithinPartitions("no").select("value").write.text(path)


def _words(c: str = "value"):
    return F.filter(F.split(F.trim(F.col(c)), r"\s+"), lambda x: x != "")


# graphs


def read_konect(spark: SparkSession, path: str, remap: bool = False, multi: str = "discard") -> Graph:
    """`% sym|asym|bip type`, perhaps `% m n1 n2`, then `u v [w]`, ids from 1. bip: ids of the second kind follow those of the first. Dynamic files are refused."""
    lines = read_lines(spark, path)
    head = [r["value"].lstrip("% ").split() for r in lines.where("no < 2 AND value LIKE '\\%%'").orderBy("no").collect()]
    if not head or head[0][0] not in ("sym", "asym", "bip"):
        raise ValueError("the first line must be `% sym|asym|bip type`")
    kind, weights = head[0][0], head[0][1] if len(head[0]) > 1 else "unweighted"
    if weights == "dynamic":
        raise ValueError("dynamic files are no graphs")
    t = lines.where("value NOT LIKE '\\%%' AND trim(value) <> ''").withColumn("t", _words())
    w = F.coalesce(F.get("t", 2).try_cast("double"), F.lit(1.0)) if weights in ("positive", "posweighted", "signed", "weighted", "multiweighted", "multisigned") else F.lit(1.0)
    shift = 0
    if kind == "bip":
        shift = int(head[1][1]) if len(head) > 1 and len(head[1]) > 1 else t.agg(F.max(F.get("t", 0).try_cast("long"))).first()[0] or 0
    e = t.select("no", (F.get("t", 0).try_cast("long") - 1).alias("src"), (F.get("t", 1).try_cast("long") - 1 + shift).alias("dst"), w.alias("weight"))
    n = int(head[1][1]) if len(head) > 1 and len(head[1]) > 1 and kind != "bip" else None
    g = Graph.from_edges(e, kind == "asym", vertices=spark.range(n) if n and not remap else None, multi=multi)
    if remap:
        from graphloom.operators.toolbox import compacted

        return compacted(g)
    return g


def read_snap_remapped(spark: SparkSession, path: str, directed: bool = False) -> tuple[Graph, DataFrame]:
    """The graph with ids numbered in order of their first mention, and (id, number)."""
    t = read_lines(spark, path).where("value NOT LIKE '#%' AND trim(value) <> ''").withColumn("t", _words())
    ends = t.select("no", F.posexplode(F.slice("t", 1, 2)).alias("k", "id"))
    first = ends.groupBy("id").agg(F.min(F.struct("no", "k")).alias("at")).select(F.col("id").try_cast("long").alias("id"), F.col("at.no").alias("no"), F.col("at.k").alias("k"))
    ids = numbered(first, "no", "k").select("id", "number")
    e = t.select("no", F.get("t", 0).try_cast("long").alias("a"), F.get("t", 1).try_cast("long").alias("b"))
    e = e.join(ids.select(F.col("id").alias("a"), F.col("number").alias("src")), "a").join(ids.select(F.col("id").alias("b"), F.col("number").alias("dst")), "b")
    return Graph.from_edges(e.select("no", "src", "dst"), directed, vertices=ids.select(F.col("number").alias("id"))), ids


def write_snap(g: Graph, path: str) -> None:
    """Comment lines with the counts, then `u<TAB>v`."""
    spark, n, m = g.vertices.sparkSession, g.vertices.count(), g.edges.count()
    head = spark.createDataFrame([(-2, f"# Nodes: {n} Edges: {m}"), (-1, "# FromNodeId\tToNodeId")], "no long, value string")
    body = numbered(g.edges.select("src", "dst"), "src", "dst", name="no").select("no", F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    _write_lines(head.union(body), path)


def write_metis(g: Graph, path: str) -> None:
    """Header `n m [1]`, then a line of neighbours (and weights) for each node; ids must be 0 to n - 1, edges undirected."""
    n, m = g.vertices.count(), g.edges.count()
    top = g.vertices.agg(F.max("id")).first()[0]
    if g.directed or (n and top != n - 1):
        raise ValueError("METIS files hold undirected graphs with ids from 0 to n - 1")
    heavy = not g.edges.where("weight <> 1").isEmpty()
    cell = lambda x: F.concat_ws(" ", (x["v"] + 1).cast("string"), x["w"].cast("string")) if heavy else (x["v"] + 1).cast("string")
    rows = g.arcs().groupBy("u").agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("p")).select(F.col("u").alias("no"), F.array_join(F.transform("p", cell), " ").alias("value"))
    body = g.vertices.select(F.col("id").alias("no")).join(rows, "no", "left").select("no", F.coalesce("value", F.lit("")).alias("value"))
    head = g.vertices.sparkSession.createDataFrame([(-1, f"{n} {m}" + " 1" * heavy)], "no long, value string")
    _write_lines(head.union(body), path)


def write_dot(g: Graph, path: str) -> None:
    spark, arrow = g.vertices.sparkSession, " -> " if g.directed else " -- "
    nodes = g.vertices.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(1.0).alias("w"))
    edges = g.edges.select(F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
    text = F.when(F.col("part") == 0, F.concat(F.col("a").cast("string"), F.lit(";"))).otherwise(F.concat(F.col("a").cast("string"), F.lit(arrow), F.col("b").cast("string"), F.lit(" [weight="), F.col("w").cast("string"), F.lit("];")))
    body = numbered(nodes.union(edges), "part", "a", "b", name="no").select("no", text.alias("value"))
    ends = spark.createDataFrame([(-1, ("digraph" if g.directed else "graph") + " {"), ((1 << 62), "}")], "no long, value string")
    _write_lines(ends.union(body), path)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) from 0 of a coordinate file; symmetric ones both ways, patterns with 1."""
    lines = read_lines(spark, path)
    head = lines.where("no = 0").first()["value"].lower().split()
    if not head[0].startswith("%%matrixmarket") or head[2] != "coordinate":
        raise ValueError("only coordinate files are read")
    body = lines.where("value NOT LIKE '\\%%' AND trim(value) <> ''").withColumn("t", _words())
    size = body.agg(F.min("no")).first()[0]
    v = F.lit(1.0) if head[3] == "pattern" else F.get("t", 2).try_cast("double")
    e = body.where(F.col("no") > size).select((F.get("t", 0).try_cast("long") - 1).alias("i"), (F.get("t", 1).try_cast("long") - 1).alias("j"), v.alias("v"))
    if head[4] in ("symmetric", "skew-symmetric"):
        sign = -1.0 if head[4].startswith("skew") else 1.0
        e = e.union(e.where("i <> j").select("j", "i", (sign * F.col("v")).alias("v")))
    return e


def read_mtx_graph(spark: SparkSession, path: str) -> Graph:
    """A square coordinate file as a graph, undirected if it is symmetric."""
    lines = read_lines(spark, path)
    head = lines.where("no = 0").first()["value"].lower().split()
    size = lines.where("value NOT LIKE '\\%%' AND trim(value) <> ''").orderBy("no").first()["value"].split()
    e = read_matrix_market(spark, path).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("weight"))
    return Graph.from_edges(e, head[4] == "general", vertices=spark.range(max(int(size[0]), int(size[1]))))


def write_matrix_market(a: DataFrame, rows: int, columns: int, path: str) -> None:
    head = a.sparkSession.createDataFrame([(-2, "%%MatrixMarket matrix coordinate real general"), (-1, f"{rows} {columns} {a.count()}")], "no long, value string")
    body = numbered(a, "j", "i", name="no").select("no", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    _write_lines(head.union(body), path)


_GML = re.compile(r'"[^"]*"|[\[\]]|[^\s\[\]"]+')


_GML_LINE = r"^\s*(?:(graph \[)|(\])|directed ([01])|node \[ id (-?\d{1,18}) \]|edge \[ source (-?\d{1,18}) target (-?\d{1,18}) weight ([-+0-9.eE]+) \])\s*$"


def _gml_lines(spark: SparkSession, path: str) -> Graph | None:
    """The graph of a file with a line for each node and edge, as write_gml has it, read as lines; None for others."""
    lines = spark.read.text(path).where("trim(value) <> '' AND trim(value) NOT LIKE '#%'")
    part = {n: F.regexp_extract("value", _GML_LINE, i) for i, n in enumerate(("open", "close", "directed", "id", "src", "dst", "weight"), 1)}
    t = lines.select("value", *(c.alias(n) for n, c in part.items()))
    heads = t.where("id = '' AND src = ''").agg(F.count_if(F.col("open") != ""), F.count_if(F.col("close") != ""), F.count_if(F.col("directed") != ""), F.count("*"), F.max("directed")).first()
    opened, closed, told, others, directed = heads
    if not (opened == closed == 1 and told <= 1 and opened + closed + told == others):
        return None
    edges = t.where("src <> ''").select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"))
    return Graph.from_edges(edges, directed == "1", vertices=t.where("id <> ''").select(F.col("id").cast("long")), multi="keep")


def read_gml(spark: SparkSession, path: str) -> Graph:
    """`graph [ directed d node [ id i ] edge [ source a target b weight w ] ]`; other keys are passed by."""
    g = _gml_lines(spark, path)
    if g is not None:
        return g
    text = "\n".join(x for x in _document(spark, path).splitlines() if not x.lstrip().startswith("#"))
    words, at = _GML.findall(text), 0

    def block() -> list[tuple[str, object]]:
        nonlocal at
        out: list[tuple[str, object]] = []
        while at < len(words) and words[at] != "]":
            key = words[at]
            at += 1
            if words[at] == "[":
                at += 1
                out.append((key, block()))
            else:
                out.append((key, words[at].strip('"')))
            at += 1
        return out

    graph = dict(block()).get("graph", [])
    directed = dict(x for x in graph if isinstance(x[1], str)).get("directed") == "1"
    nodes = [(int(dict(v)["id"]),) for k, v in graph if k == "node"]
    edges = [(int(d["source"]), int(d["target"]), float(d.get("weight", d.get("value", 1.0)))) for d in (dict(v) for k, v in graph if k == "edge")]
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"), directed, vertices=spark.createDataFrame(nodes, "id long"), multi="keep")


def write_gml(g: Graph, path: str) -> None:
    spark = g.vertices.sparkSession
    nodes = g.vertices.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(1.0).alias("w"))
    edges = g.edges.select(F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
    node = F.concat(F.lit("  node [ id "), F.col("a").cast("string"), F.lit(" ]"))
    edge = F.concat(F.lit("  edge [ source "), F.col("a").cast("string"), F.lit(" target "), F.col("b").cast("string"), F.lit(" weight "), F.col("w").cast("string"), F.lit(" ]"))
    body = numbered(nodes.union(edges), "part", "a", "b", name="no").select("no", F.when(F.col("part") == 0, node).otherwise(edge).alias("value"))
    ends = spark.createDataFrame([(-2, "graph ["), (-1, f"  directed {int(g.directed)}"), ((1 << 62), "]")], "no long, value string")
    _write_lines(ends.union(body), path)


def _strip(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml_graph(spark: SparkSession, nodes: list[str], edges: list[tuple[str, str, float]], directed: bool) -> tuple[Graph, DataFrame]:
    number = {x: i for i, x in enumerate(nodes)}
    rows = [(number[a], number[b], w) for a, b, w in edges]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight double"), directed, vertices=spark.range(len(nodes)), multi="keep")
    return g, spark.createDataFrame(list(number.items()), "name string, id long")


def read_graphml(spark: SparkSession, path: str, weight_key: str = "weight") -> tuple[Graph, DataFrame]:
    """The graph with nodes numbered in file order, and (name, id)."""
    root = ET.fromstring(_document(spark, path))
    keys = {k.get("id"): k.get("attr.name") for k in root.iter() if _strip(k.tag) == "key"}
    graph = next(x for x in root.iter() if _strip(x.tag) == "graph")
    nodes = [x.get("id") for x in graph.iter() if _strip(x.tag) == "node"]
    edges = []
    for e in (x for x in graph.iter() if _strip(x.tag) == "edge"):
        w = [float(d.text) for d in e if keys.get(d.get("key"), d.get("key")) == weight_key]
        edges.append((e.get("source"), e.get("target"), w[0] if w else 1.0))
    return _xml_graph(spark, nodes, edges, graph.get("edgedefault") == "directed")


def write_graphml(g: Graph, path: str) -> None:
    kind = "directed" if g.directed else "undirected"
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/>', f'<graph edgedefault="{kind}">']
    node = F.concat(F.lit('<node id="'), F.col("a").cast("string"), F.lit('"/>'))
    edge = F.concat(F.lit('<edge source="'), F.col("a").cast("string"), F.lit('" target="'), F.col("b").cast("string"), F.lit('"><data key="weight">'), F.col("w").cast("string"), F.lit("</data></edge>"))
    _write_parts(g, path, head, node, edge, ["</graph></graphml>"])


def read_gexf(spark: SparkSession, path: str) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph, (name, id), and the events (seq, type, u, v, w) of spells (start, end) of a dynamic file, in order of time."""
    root = ET.fromstring(_document(spark, path))
    graph = next(x for x in root.iter() if _strip(x.tag) == "graph")
    nodes, edges, spells = [], [], []
    for x in graph.iter():
        if _strip(x.tag) == "node":
            nodes.append(x.get("id"))
        if _strip(x.tag) == "edge":
            edges.append((x.get("source"), x.get("target"), float(x.get("weight", 1.0))))
    number = {x: i for i, x in enumerate(nodes)}
    for x in graph.iter():
        tag = _strip(x.tag)
        if tag not in ("node", "edge"):
            continue
        what = ("NODE", number[x.get("id")], None, None) if tag == "node" else ("EDGE", number[x.get("source")], number[x.get("target")], float(x.get("weight", 1.0)))
        times = [(s.get("start"), s.get("end")) for s in x.iter() if _strip(s.tag) == "spell"] or [(x.get("start"), x.get("end"))]
        for start, end in times:
            if start is not None:
                spells.append((start, 0 if tag == "node" else 1, f"{what[0]}_ADDITION", *what[1:]))
            if end is not None:
                spells.append((end, 3 if tag == "node" else 2, f"{what[0]}_REMOVAL", *what[1:]))
    when = lambda t: (0, float(t)) if re.fullmatch(r"-?[0-9.]+", t[0]) or re.fullmatch(r"-?[0-9.]+", t) else (1, t)
    spells.sort(key=lambda s: (when(s[0]) if re.fullmatch(r"-?[0-9.]+", s[0]) else (1, s[0]), s[1]))
    rows, last, seq = [], None, 0
    for t, _, kind, u, v, w in spells:
        if last is not None and t != last:
            rows.append((seq, "TIME_STEP", None, None, None))
            seq += 1
        rows.append((seq, kind, u, v, w))
        last, seq = t, seq + 1
    g, ids = _xml_graph(spark, nodes, edges, graph.get("defaultedgetype") == "directed")
    return g, ids, spark.createDataFrame(rows, "seq long, type string, u long, v long, w double")


def write_gexf(g: Graph, path: str) -> None:
    kind = "directed" if g.directed else "undirected"
    head = ['<?xml version="1.0" encoding="UTF-8"?>', f'<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="{kind}" mode="static">']
    node = F.concat(F.lit('<node id="'), F.col("a").cast("string"), F.lit('"/>'))
    edge = F.concat(F.lit('<edge source="'), F.col("a").cast("string"), F.lit('" target="'), F.col("b").cast("string"), F.lit('" weight="'), F.col("w").cast("string"), F.lit('"/>'))
    _write_parts(g, path, head, node, edge, ["</graph></gexf>"])


def _write_parts(g: Graph, path: str, head: list[str], node, edge, foot: list[str]) -> None:
    nodes = g.vertices.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(1.0).alias("w"))
    edges = g.edges.select(F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
    body = numbered(nodes.union(edges), "part", "a", "b", name="no").select("no", F.when(F.col("part") == 0, node).otherwise(edge).alias("value"))
    ends = [(i - len(head), x) for i, x in enumerate(head)] + [((1 << 62) + i, x) for i, x in enumerate(foot)]
    _write_lines(g.vertices.sparkSession.createDataFrame(ends, "no long, value string").union(body), path)


# partitions and covers


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """(node, community): one community per line, nodes by line number."""
    return read_lines(spark, path).where("trim(value) <> '' AND value NOT LIKE '#%'").select(F.col("no").alias("node"), F.trim("value").try_cast("long").alias("community"))


def write_partition(p: DataFrame, path: str) -> None:
    """Nodes must be 0 to n - 1."""
    _write_lines(p.select(F.col("node").alias("no"), F.col("community").cast("string").alias("value")), path)


def read_partition_list(spark: SparkSession, path: str, first_node: int = 1, separator: str = r"\s+") -> DataFrame:
    """`node SEP community` lines."""
    t = F.split(F.trim("value"), separator)
    return spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'").select((t[0].try_cast("long") - first_node).alias("node"), t[1].try_cast("long").alias("community"))


def read_cover(spark: SparkSession, path: str) -> DataFrame:
    """(node, community): a line of nodes for each community, numbered in order."""
    t = numbered(read_lines(spark, path).where("trim(value) <> '' AND value NOT LIKE '#%'"), "no", name="community")
    return t.select(F.explode(_words()).alias("node"), "community").select(F.col("node").try_cast("long").alias("node"), "community")


def write_cover(cover: DataFrame, path: str) -> None:
    rows = cover.groupBy(F.col("community").alias("no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), " ").alias("value"))
    _write_lines(rows, path)


def read_cover_list(spark: SparkSession, path: str, first_node: int = 1) -> DataFrame:
    """`node c1 c2 ...` lines."""
    t = spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'").withColumn("t", _words())
    return t.select((F.get("t", 0).try_cast("long") - first_node).alias("node"), F.explode(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))).alias("community")).select("node", F.col("community").try_cast("long").alias("community"))


def read_snap_cover(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """A line of outside ids for each community, put through ids (id, number)."""
    c = read_cover(spark, path).withColumnRenamed("node", "id")
    return c.join(ids, "id").select(F.col("number").alias("node"), "community")


def read_binary_partition(spark: SparkSession, path: str, width: int = 4, pairs: bool = False, first_node: int = 0) -> DataFrame:
    """(node, community) of little-endian numbers of width bytes: communities by place, or (node, community) pairs; all bits set means none."""
    row = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if row["length"] > MAX_DOCUMENT:
        raise ValueError(f"files of more than {MAX_DOCUMENT} bytes are not read")
    x = np.frombuffer(bytes(row["content"]), dtype=f"<u{width}")
    node, c = (x[::2].astype(np.int64) - first_node, x[1::2]) if pairs else (np.arange(len(x)), x)
    keep = c != np.iinfo(c.dtype).max
    return spark.createDataFrame(list(zip(node[keep].tolist(), c[keep].astype(np.int64).tolist(), strict=True)), "node long, community long")


def binary_partition(p: DataFrame, width: int = 4, pairs: bool = False, first_node: int = 0) -> bytes:
    """The bytes that read_binary_partition reads."""
    t = p.select("node", "community").orderBy("node").toArrow()
    node, c = t.column(0).to_numpy(), t.column(1).to_numpy()
    if pairs:
        out = np.stack([node + first_node, c], axis=1).ravel().astype(f"<u{width}")
    else:
        out = np.full(int(node.max()) + 1 if len(node) else 0, np.iinfo(f"u{width}").max, dtype=f"<u{width}")
        out[node] = c
    return out.tobytes()


# event streams


def read_dgs(spark: SparkSession, path: str, mapped: bool = True, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """Events (seq, type, u, v, w) of a DGS file, and (name, id): names numbered by first mention, or numbers less base."""
    t = read_lines(spark, path).where("no > 1 AND trim(value) <> '' AND value NOT LIKE '#%'").withColumn("t", _words())
    code, a, b = F.get("t", 0), F.get("t", 1), F.get("t", 2)
    kinds = {"an": "NODE_ADDITION", "dn": "NODE_REMOVAL", "rn": "NODE_RESTORATION", "ae": "EDGE_ADDITION", "de": "EDGE_REMOVAL", "ce": "EDGE_WEIGHT_UPDATE", "ie": "EDGE_WEIGHT_INCREMENT", "st": "TIME_STEP"}
    kind = F.create_map(*(F.lit(x) for k in kinds.items() for x in k))[code]
    clean = lambda c: F.regexp_replace(c, '"', "")
    pair = F.split(clean(a), "-")
    # `ae id u v`, or an id u-v alone
    u = F.when(code == "st", None).when(code.isin("an", "dn", "rn"), clean(a)).when((code == "ae") & (F.size("t") >= 4) & ~b.contains("="), clean(b)).otherwise(pair[0])
    v = F.when(code.isin("an", "dn", "rn", "st"), None).when((code == "ae") & (F.size("t") >= 4) & ~b.contains("="), clean(F.get("t", 3))).otherwise(F.get(pair, 1))
    w = F.regexp_extract("value", r"weight\s*=\s*([-+0-9.eE]+)", 1)
    e = t.select("no", kind.alias("type"), u.alias("a"), v.alias("b"), F.when(kind.isin("EDGE_ADDITION", "EDGE_WEIGHT_UPDATE", "EDGE_WEIGHT_INCREMENT"), F.when(w != "", w.try_cast("double")).otherwise(1.0)).alias("w")).where("type IS NOT NULL")
    names = e.select("no", F.posexplode(F.array("a", "b")).alias("k", "name")).where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("no", "k")).alias("at"))
    names = names.select("name", F.col("at.no").alias("no"), F.col("at.k").alias("k"))
    ids = numbered(names, "no", "k", name="id").select("name", "id") if mapped else names.select("name", (F.col("name").try_cast("long") - base).alias("id"))
    e = e.join(ids.select(F.col("name").alias("a"), F.col("id").alias("u")), "a", "left").join(ids.select(F.col("name").alias("b"), F.col("id").alias("v")), "b", "left")
    return numbered(e.select("no", "type", "u", "v", "w"), "no", name="seq").select("seq", "type", "u", "v", "w"), ids


def write_dgs(events: DataFrame, path: str) -> None:
    """Events (seq, type, u, v, w) as a DGS file."""
    s = lambda c: F.col(c).cast("string")
    pair, weight = F.concat(s("u"), F.lit("-"), s("v")), F.concat(F.lit(" weight="), s("w"))
    text = (
        F.when(F.col("type") == "NODE_ADDITION", F.concat(F.lit("an "), s("u"))).when(F.col("type") == "NODE_REMOVAL", F.concat(F.lit("dn "), s("u"))).when(F.col("type") == "NODE_RESTORATION", F.concat(F.lit("rn "), s("u")))
        .when(F.col("type") == "EDGE_ADDITION", F.concat(F.lit("ae "), pair, F.lit(" "), s("u"), F.lit(" "), s("v"), weight)).when(F.col("type") == "EDGE_REMOVAL", F.concat(F.lit("de "), pair))
        .when(F.col("type") == "EDGE_WEIGHT_UPDATE", F.concat(F.lit("ce "), pair, weight)).when(F.col("type") == "EDGE_WEIGHT_INCREMENT", F.concat(F.lit("ie "), pair, weight)).otherwise("st")
    )
    head = events.sparkSession.createDataFrame([(-2, "DGS004"), (-1, "events 0 0")], "no long, value string")
    _write_lines(head.union(events.select(F.col("seq").alias("no"), text.alias("value"))), path)


# one entry for all


READERS = {}


def _readers() -> dict:
    from graphloom.sources import files

    first = lambda f: lambda spark, path: f(spark, path)[0]
    return {
        "edgelist": files.read_edge_list, "metis": files.read_metis, "snap": files.read_snap, "coo": files.from_coo, "konect": read_konect, "mtx": read_mtx_graph,
        "gml": read_gml, "graphml": first(read_graphml), "gexf": first(read_gexf),
    }


def _writers() -> dict:
    from graphloom.sources import files

    return {"edgelist": files.write_edge_list, "metis": write_metis, "snap": write_snap, "dot": write_dot, "gml": write_gml, "graphml": write_graphml, "gexf": write_gexf}


def guess_format(path: str, first_line: str) -> str:
    """By the first line, then by the ending."""
    line = first_line.strip().lower()
    if line.startswith("%%matrixmarket"):
        return "mtx"
    if re.match(r"% (sym|asym|bip)", line):
        return "konect"
    if line.startswith("<?xml") or line.startswith("<g"):
        return "gexf" if path.endswith("gexf") else "graphml"
    if line.startswith("graph [") or line.startswith("graph[") or path.endswith(".gml"):
        return "gml"
    if path.endswith((".graph", ".metis")):
        return "metis"
    return "snap" if line.startswith("#") else "edgelist"


def read_graph(spark: SparkSession, path: str, kind: str | None = None, **options) -> Graph:
    if kind is None:
        row = spark.read.text(path).first()
        kind = guess_format(path, row["value"] if row else "")
    return _readers()[kind](spark, path, **options)


def write_graph(g: Graph, path: str, kind: str, **options) -> None:
    _writers()[kind](g, path, **options)


def read_graphs(spark: SparkSession, paths: list[str], kind: str | None = None, **options) -> dict[str, Graph]:
    return {p: read_graph(spark, p, kind, **options) for p in paths}


def convert_graph(spark: SparkSession, source: str, target: str, to: str, kind: str | None = None) -> None:
    write_graph(read_graph(spark, source, kind), target, to)
