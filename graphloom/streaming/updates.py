"""Event streams applied to graphs: batches with a timeline, differences of graphs as events, and Structured Streaming that keeps an edge table up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.numbering import numbered
from graphloom.plans.scratch import materialize
from graphloom.streaming.events import replay

NODE_ON = ("NODE_ADDITION", "NODE_RESTORATION")


def updated(g: Graph, events: DataFrame) -> Graph:
    """g after events (seq, type, u, v, w) in order of seq. Nodes must have lost their edges before they go; edges of unknown nodes bring them."""
    first = g.edges.select(F.lit(-1).cast("long").alias("seq"), F.lit("EDGE_ADDITION").alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("w"))
    e = events.where("type LIKE 'EDGE%'").select("seq", "type", "u", "v", "w")
    if not g.directed:
        e = e.withColumns({"u": F.greatest("u", "v"), "v": F.least("u", "v")})
    edges = materialize(replay(first.union(e)).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight")), "edges")
    last = events.where("type LIKE 'NODE%'").groupBy(F.col("u").alias("id")).agg(F.max_by("type", "seq").alias("t"))
    on, off = last.where(F.col("t").isin(*NODE_ON)).select("id"), last.where("t = 'NODE_REMOVAL'").select("id")
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    bad = ends.join(off, "id", "left_semi")
    if not bad.isEmpty():
        raise ValueError("a node was removed that still has edges")
    v = g.vertices.select("id").union(on).union(ends).distinct().join(off, "id", "left_anti")
    return Graph(v, edges, g.directed)


def timeline(g: Graph, events: DataFrame) -> DataFrame:
    """(step, nodes, edges): sizes at each TIME_STEP, 0 being the start; from changes of single edges and nodes, added up."""
    block = F.floor(F.col("seq") / 100_000)  # steps before an event: those of earlier blocks, and those before it in its own
    stepped = events.withColumn("b", block).withColumn("t", (F.col("type") == "TIME_STEP").cast("long"))
    sums = stepped.groupBy("b").agg(F.sum("t").alias("k"))
    base = sums.select("b", F.coalesce(F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("t").over(Window.partitionBy("b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = stepped.withColumn("own", own).join(base, "b").withColumn("step", F.col("base") + F.col("own"))
    pair = e.where("type LIKE 'EDGE%'").select("seq", "step", "type", *((F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if not g.directed else ("u", "v")))
    here = g.edges.select(F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("step"), F.lit("EDGE_ADDITION").alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"))
    w = Window.partitionBy("u", "v").orderBy("seq")
    state = F.when(F.col("type") == "EDGE_REMOVAL", 0).otherwise(1)
    edge = pair.union(here).withColumn("s", state).withColumn("d", F.col("s") - F.coalesce(F.lag("s").over(w), F.lit(0))).select("step", F.lit(0).alias("dn"), F.col("d").alias("dm"))
    nodes = e.where("type LIKE 'NODE%'").select("seq", "step", "type", "u").union(g.vertices.select(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit("NODE_ADDITION"), "id"))
    node_state = F.when(F.col("type") == "NODE_REMOVAL", 0).otherwise(1)
    node = nodes.withColumn("s", node_state).withColumn("d", F.col("s") - F.coalesce(F.lag("s").over(Window.partitionBy("u").orderBy("seq")), F.lit(0))).select("step", F.col("d").alias("dn"), F.lit(0).alias("dm"))
    sums = edge.union(node).groupBy("step").agg(F.sum("dn").alias("dn"), F.sum("dm").alias("dm"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row per step
    return sums.select((F.col("step") + 1).alias("step"), F.sum("dn").over(upto).alias("nodes"), F.sum("dm").over(upto).alias("edges"))


def difference(one: Graph, two: Graph) -> DataFrame:
    """Events (seq, type, u, v, w) that make two of one: edges go, then nodes go and come, then edges come or change weight."""
    key = ["src", "dst"]
    a, b = one.edges.select("src", "dst", F.col("weight").alias("x")), two.edges.select("src", "dst", F.col("weight").alias("y"))
    both = materialize(a.join(b, key, "full"), "diff")
    event = lambda rows, part, kind, w: rows.select(F.lit(part).alias("part"), F.lit(kind).alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w"))
    none = F.lit(None).cast("double")
    node = lambda rows, part, kind: rows.select(F.lit(part).alias("part"), F.lit(kind).alias("type"), F.col("id").alias("u"), F.lit(None).cast("long").alias("v"), none.alias("w"))
    rows = event(both.where("y IS NULL"), 0, "EDGE_REMOVAL", none)
    rows = rows.union(node(one.vertices.select("id").join(two.vertices, "id", "left_anti"), 1, "NODE_REMOVAL")).union(node(two.vertices.select("id").join(one.vertices, "id", "left_anti"), 2, "NODE_ADDITION"))
    rows = rows.union(event(both.where("x IS NULL"), 3, "EDGE_ADDITION", F.col("y"))).union(event(both.where("x <> y"), 4, "EDGE_WEIGHT_UPDATE", F.col("y")))
    return numbered(rows, "part", "u", "v", name="seq").select("seq", "type", "u", "v", "w")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


def graph_from_events(events: DataFrame, directed: bool = False) -> Graph:
    spark = events.sparkSession
    return updated(Graph(spark.range(0), spark.createDataFrame([], "src long, dst long, weight double"), directed), events)


class Watched:
    """A graph whose handlers are told of every batch of events that is applied."""

    def __init__(self, g: Graph):
        self.graph, self.handlers = g, []

    def register(self, handler: Callable[[Graph, DataFrame], None]) -> None:
        self.handlers.append(handler)

    def apply(self, events: DataFrame) -> Graph:
        self.graph = updated(self.graph, events)
        for h in self.handlers:
            h(self.graph, events)
        return self.graph


class Algorithm:
    """A calculation that runs once: run(), then result; asking before is an error."""

    def __init__(self, f: Callable[..., DataFrame], *args, **options):
        self._f, self._args, self._options, self._result = f, args, options, None

    def run(self) -> Algorithm:
        self._result = self._f(*self._args, **self._options)
        return self

    def has_finished(self) -> bool:
        return self._result is not None

    @property
    def result(self) -> DataFrame:
        if self._result is None:
            raise RuntimeError("run() comes first")
        return self._result


class Maintained(Algorithm):
    """A calculation on a watched graph that is brought up to date with each batch: by step(result, graph, events), or run anew without one."""

    def __init__(self, watched: Watched, f: Callable[[Graph], DataFrame], step: Callable[[DataFrame, Graph, DataFrame], DataFrame] | None = None):
        super().__init__(lambda: f(watched.graph))
        self._step, self._whole = step, f
        watched.register(self.update)

    def update(self, g: Graph, events: DataFrame) -> None:
        if self.has_finished():
            self._result = self._step(self._result, g, events) if self._step else self._whole(g)


def dynamic_components(watched: Watched) -> Maintained:
    """Connected components: added edges merge labels, removed ones reopen their components alone."""
    from graphloom.operators.iterative import connected_components
    from graphloom.operators.paths import merged_components, split_components

    def step(c: DataFrame, g: Graph, events: DataFrame) -> DataFrame:
        e = events.select("type", F.col("u").alias("src"), F.col("v").alias("dst"))
        fresh = g.vertices.join(c.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.col("id").alias("component"))
        c = materialize(c.join(g.vertices.select(F.col("id").alias("node")), "node", "left_semi").select("node", "component").union(fresh), "comp")
        gone = e.where("type = 'EDGE_REMOVAL'").select("src", "dst")
        if not gone.isEmpty():
            c = materialize(split_components(g, c, gone), "comp")
        return materialize(merged_components(c, e.where("type = 'EDGE_ADDITION'").select("src", "dst")), "comp")

    return Maintained(watched, connected_components, step)


def dynamic_distances(watched: Watched, source: int, weighted: bool = True) -> Maintained:
    """Distances from a source: added and lightened edges relax from their ends, other events run it anew."""
    from graphloom.operators.iterative import bfs, shortest_paths
    from graphloom.operators.paths import relaxed

    def whole(g: Graph) -> DataFrame:
        s = g.vertices.where(F.col("id") == source).select("id")
        return shortest_paths(g, s) if weighted else bfs(g, s).select("node", F.col("distance").cast("double").alias("distance"))

    def step(d: DataFrame, g: Graph, events: DataFrame) -> DataFrame:
        if not events.where("type IN ('EDGE_REMOVAL', 'EDGE_WEIGHT_UPDATE', 'EDGE_WEIGHT_INCREMENT', 'NODE_REMOVAL')").isEmpty():
            return whole(g)
        new = events.where("type = 'EDGE_ADDITION'").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight"))
        return relaxed(g, d, new, weighted)

    return Maintained(watched, whole, step)


def run_stream(stream: DataFrame, watched: Watched, checkpoint: str):
    """A Structured Streaming query that applies each micro-batch of events (seq, type, u, v, w) to a watched graph."""
    return stream.writeStream.foreachBatch(lambda batch, _: watched.apply(materialize(batch, "batch"))).option("checkpointLocation", checkpoint).start()
