"""Centralities kept up to date with the batches of a watched graph: what a batch can't have changed is neither searched nor read again.

The levels of a search say which sources a batch concerns. An arc (u, v) that comes changes nothing for a source that
does not reach u, or reached v no later than u; one that goes changes nothing unless v was reached one hop after u. If
no arc of a batch concerns a source, its distances, counts of paths and shares stay as they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.distances import dependencies, distances
from graphloom.plans.scratch import discard, materialize
from graphloom.streaming.updates import Algorithm, Watched

#: Folders that sources are dealt to, so that the rows of a few can be read without the others.
LOTS = 16
#: Generations of rows after which all are written anew as one.
MERGE = 8


def changes(old: Graph, new: Graph, events: DataFrame) -> DataFrame:
    """(u, v, sign): arcs of the pairs in events that new has and old lacks (1), or the other way (-1); loops and weights don't count."""
    pairs = events.where("type LIKE 'EDGE%' AND u <> v").select("u", "v")
    if not old.directed:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = pairs.distinct()

    def there(g: Graph, sign: int) -> DataFrame:
        return pairs.join(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_semi").select("u", "v", F.lit(sign).alias("sign"))

    e = there(old, -1).union(there(new, 1)).groupBy("u", "v").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return materialize(e if old.directed else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "sign")), "changes")


def concerned(changed: DataFrame, at: DataFrame) -> DataFrame:
    """(source): those of at(source, node, distance) whose shortest paths the arcs (u, v, sign) change. at needs the rows of the arcs' ends alone."""
    a = at.select("source", F.col("node").alias("u"), F.col("distance").alias("du"))
    b = at.select("source", F.col("node").alias("v"), F.col("distance").alias("dv"))
    both = changed.join(a, "u").join(b, ["source", "v"], "left")
    return both.where("CASE WHEN sign = 1 THEN dv IS NULL OR du + 1 <= dv ELSE dv = du + 1 END").select("source").distinct()


def _ends(changed: DataFrame) -> DataFrame:
    return changed.select(F.col("u").alias("node")).union(changed.select("v")).distinct()


class _Searches:
    """Rows (source, node, ...) of many searches, in generations: a source's rows are those of the last generation that searched from it, so that an update writes no more than it searched."""

    def __init__(self) -> None:
        self._parts: list[DataFrame] = []
        self._live: DataFrame | None = None

    def put(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        """The rows as written, in place of what was known of sources(source)."""
        lot = F.pmod(F.hash("source"), F.lit(LOTS)).alias("lot")
        part = materialize(rows.select("*", lot).repartition("lot", "node"), "searches", by="lot")
        mine = sources.select("source", F.lit(len(self._parts)).alias("gen"))
        old = self._live
        self._live = materialize(mine if old is None else old.join(sources, "source", "left_anti").select("source", "gen").union(mine), "live")
        self._parts.append(part)
        discard(old)
        return part

    def drop(self, sources: DataFrame) -> None:
        old, self._live = self._live, materialize(self._live.join(sources, "source", "left_anti"), "live")
        discard(old)

    def sources(self) -> DataFrame:
        return self._live.select("source")

    def rows(self, nodes: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
        """All rows, or those of nodes(node), or those of sources(source), of which only the folders are read."""
        lots = None
        if sources is not None:
            lots = [r["lot"] for r in sources.select(F.pmod(F.hash("source"), F.lit(LOTS)).alias("lot")).distinct().collect()]  # at most LOTS
        each = []
        for gen, part in enumerate(self._parts):
            if lots is not None:
                part = part.where(F.col("lot").isin(lots)) if lots else part.where("false")
            if nodes is not None:
                part = part.join(nodes, "node", "left_semi")
            each.append(part.withColumn("gen", F.lit(gen)))
        live = self._live if sources is None else self._live.join(sources, "source", "left_semi")
        return reduce(DataFrame.unionByName, each).join(live, ["source", "gen"], "left_semi").drop("gen", "lot")

    def merged(self) -> bool:
        """Whether there were generations enough to write all rows as one."""
        if len(self._parts) < MERGE:
            return False
        rows, sources, old = self.rows(), self.sources(), [*self._parts, self._live]
        one = _Searches()
        one.put(rows, sources)
        self._parts, self._live = one._parts, one._live
        discard(*old)
        return True


class KeptBetweenness(Algorithm):
    """(node, score) as betweenness has it, of a watched graph, from all sources or a fixed sample of them.

    Kept are (source, node, distance, paths, own) and the sums of own. A batch searches anew from the sources that it
    concerns, takes their old shares off the sums and adds the new. searched is the number of sources of the last
    batch. Nodes that come are sources too, unless there is a sample; nodes that go take their rows along.
    """

    def __init__(self, watched: Watched, sources: DataFrame | None = None):
        super().__init__(self._whole)
        self._watched, self._chosen, self._kept, self.searched = watched, sources, _Searches(), 0
        watched.register(self.update)

    def _search(self, g: Graph, sources: DataFrame) -> DataFrame:
        return dependencies(g, sources.select(F.col("source").alias("id")))

    def _whole(self) -> DataFrame:
        self._graph = g = self._watched.graph
        ids = g.vertices if self._chosen is None else self._chosen.join(g.vertices, "id", "left_semi").distinct()
        sources = ids.select(F.col("id").alias("source"))
        self._kept = _Searches()
        self._begin(self._kept.put(self._search(g, sources), sources))
        return self._scores(g)

    def _begin(self, rows: DataFrame) -> None:
        self._sums = materialize(rows.groupBy("node").agg(F.sum("own").alias("own")), "sums")

    def _scores(self, g: Graph) -> DataFrame:
        n, took = g.vertices.count(), self._kept.sources().count()
        scale = n / took if took else 1.0
        return g.vertices.select(F.col("id").alias("node")).join(self._sums, "node", "left").select("node", (F.coalesce("own", F.lit(0.0)) * scale).alias("score"))

    def _swap(self, before: DataFrame, now: DataFrame) -> None:
        change = before.select("node", (-F.col("own")).alias("own")).union(now.select("node", "own")).where("own <> 0")
        old, self._sums = self._sums, materialize(self._sums.union(change).groupBy("node").agg(F.sum("own").alias("own")), "sums")
        discard(old)

    def update(self, g: Graph, events: DataFrame) -> None:
        """The result after a batch; nothing before run()."""
        if not self.has_finished():
            return
        kept, changed = self._kept, changes(self._graph, g, events)
        hit = concerned(changed, materialize(kept.rows(nodes=_ends(changed)).select("source", "node", "distance"), "ends"))
        gone = kept.sources().join(g.vertices.select(F.col("id").alias("source")), "source", "left_anti")
        come = g.vertices if self._chosen is None else self._chosen.join(g.vertices, "id", "left_semi").distinct()
        come = come.select(F.col("id").alias("source")).join(kept.sources(), "source", "left_anti")
        stale = materialize(hit.union(gone).distinct(), "stale")
        again = materialize(hit.join(gone, "source", "left_anti").union(come), "again")
        self.searched = again.count()
        if self.searched or not stale.isEmpty():
            before = kept.rows(sources=stale)
            old = materialize(self._outline(before), "before")
            kept.drop(stale)
            now = kept.put(self._search(g, again), again)
            self._swap(old, now)
            if kept.merged():
                self._begin(kept.rows())
        self._graph, self._result = g, self._scores(g)

    def _outline(self, rows: DataFrame) -> DataFrame:
        """What _swap needs of the rows that go."""
        return rows.groupBy("node").agg(F.sum("own").alias("own"))


class KeptBetweennessOf(KeptBetweenness):
    """(node, score): betweenness of a single node of a watched graph; no row while the graph lacks it.

    Shares are not walked back: of each source's paths to a node, those through the one are counted by the paths to it
    and from it, where the distances add up. What a source adds is kept, and counted again only when a batch concerns it.
    """

    def __init__(self, watched: Watched, node: int):
        super().__init__(watched)
        self._node = node

    def _search(self, g: Graph, sources: DataFrame) -> DataFrame:
        return distances(g, sources.select(F.col("source").alias("id")))

    def _shares(self, rows: DataFrame) -> DataFrame:
        """(source, own) of searches whose rows are given whole."""
        one = rows.sparkSession.createDataFrame([(self._node,)], "source long")
        onward = self._kept.rows(sources=one).where(F.col("source") == self._node).select("node", F.col("distance").alias("dx"), F.col("paths").alias("px"))
        to = rows.where(F.col("node") == self._node).select("source", F.col("distance").alias("ds"), F.col("paths").alias("ps"))
        through = rows.where((F.col("source") != self._node) & (F.col("node") != self._node)).join(to, "source").join(onward, "node").where("ds + dx = distance")
        return through.groupBy("source").agg(F.sum(F.col("ps") * F.col("px") / F.col("paths")).alias("own"))

    def _begin(self, rows: DataFrame) -> None:
        self._sums = materialize(self._shares(rows), "sums")

    def _outline(self, rows: DataFrame) -> DataFrame:
        return rows.select("source").distinct()

    def _swap(self, before: DataFrame, now: DataFrame) -> None:
        stay = self._sums.join(before, "source", "left_anti").select("source", "own")
        old, self._sums = self._sums, materialize(stay.union(self._shares(now)), "sums")
        discard(old)

    def _scores(self, g: Graph) -> DataFrame:
        total = self._sums.agg(F.coalesce(F.sum("own"), F.lit(0.0)).alias("score"))
        return total.select(F.lit(self._node).cast("long").alias("node"), "score").join(g.vertices.select(F.col("id").alias("node")), "node", "left_semi")


def _transposed(g: Graph) -> Graph:
    return Graph(g.vertices, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), True) if g.directed else g


def _reaching(g: Graph, ends: DataFrame) -> DataFrame:
    """(node, end, distance) of the nodes from which each of ends(node) is reached."""
    d = distances(_transposed(g), ends.select(F.col("node").alias("id")))
    return materialize(d.select("node", F.col("source").alias("end"), "distance"), "reaching")


class KeptTopHarmonic(Algorithm):
    """(node, score): exactly the k nodes of greatest harmonic closeness over n - 1 of a watched graph, ties to smaller ids.

    Kept is (node, most, exact): a bound of the sum of 1 / distance, which is the sum itself once a node was searched
    from. Batches of nodes are searched from, the greatest bounds first, until the k best sums exceed all bounds. Arcs
    that go leave a bound as it is, and exact unless they concern the node. Arcs (u, v) that come add at most what the
    nodes at j hops from v gain when they are reached by u, for each j. searched is the number of searches of the last
    batch. The rows that weigh a batch grow with its arcs times the nodes that reach them.
    """

    def __init__(self, watched: Watched, k: int = 1, batch: int = 1024):
        super().__init__(self._whole)
        self._watched, self._k, self._batch, self.searched = watched, k, batch, 0
        watched.register(self.update)

    def _whole(self) -> DataFrame:
        from graphloom.operators.iterative import connected_components

        self._graph = g = self._watched.graph
        comp = materialize(connected_components(g), "comp")
        size = comp.groupBy("component").agg(F.count("*").alias("size"))
        self._bounds = materialize(self._first(g, comp.join(size, "component").select("node", "size")), "bounds")
        return self._settled(g)

    @staticmethod
    def _first(g: Graph, size: DataFrame) -> DataFrame:
        """Bounds of nodes(node, size) that reach size nodes at most: neighbours at one hop, all else at two."""
        degree = g.arcs().where("u <> v").select("u", "v").distinct().groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
        most = F.coalesce("degree", F.lit(0)) + (F.col("size") - 1 - F.coalesce("degree", F.lit(0))) / 2.0
        return size.join(degree, "node", "left").select("node", most.cast("double").alias("most"), F.lit(False).alias("exact"))

    def _put(self, bounds: DataFrame) -> None:
        old, self._bounds = self._bounds, materialize(bounds, "bounds")
        discard(old)

    def _settled(self, g: Graph) -> DataFrame:
        from graphloom.operators.multisource import reach_counts

        n, spark, self.searched = g.vertices.count(), g.vertices.sparkSession, 0
        while True:
            rank = [F.round("most", 12).desc(), F.col("node")]
            best = self._bounds.where("exact").orderBy(*rank).limit(self._k).collect()
            floor = best[-1]["most"] if best and len(best) == self._k else -1.0
            lot = materialize(self._bounds.where(~F.col("exact") & (F.col("most") >= floor - 1e-9)).orderBy(*rank).limit(self._batch).select("node"), "lot")
            took = lot.count() if self._k > 0 else 0
            if not took:
                return spark.createDataFrame([(r["node"], r["most"] / max(n - 1, 1)) for r in best], "node long, score double")
            self.searched += took
            each = F.when(F.col("hop") > 0, F.col("nodes") / F.col("hop")).otherwise(0.0)
            found = reach_counts(g, lot.select(F.col("node").alias("id"))).groupBy(F.col("source").alias("node")).agg(F.sum(each).alias("x"))
            both = self._bounds.join(found, "node", "left")
            self._put(both.select("node", F.coalesce("x", "most").alias("most"), (F.col("exact") | F.col("x").isNotNull()).alias("exact")))

    def update(self, g: Graph, events: DataFrame) -> None:
        """The result after a batch; nothing before run()."""
        if not self.has_finished():
            return
        old, changed = self._graph, changes(self._graph, g, events)
        gone, come = changed.where("sign = -1"), changed.where("sign = 1")
        doubt: list[DataFrame] = []
        between = old
        if not gone.isEmpty():
            at = _reaching(old, _ends(gone)).select(F.col("node").alias("source"), F.col("end").alias("node"), "distance")
            doubt.append(concerned(gone, at))
            lost = gone.select(F.col("u").alias("src"), F.col("v").alias("dst"))  # both directions of undirected edges
            between = Graph(old.vertices, materialize(old.edges.join(lost, ["src", "dst"], "left_anti"), "edges"), old.directed)
        between = Graph(old.vertices.select("id").union(g.vertices.select("id")).distinct(), between.edges, old.directed)
        bounds = self._bounds.join(g.vertices.select(F.col("id").alias("node")), "node", "left_semi")
        fresh = g.vertices.select(F.col("id").alias("node")).join(self._bounds, "node", "left_anti")
        bounds = bounds.union(self._first(g, fresh.select("node", F.lit(g.vertices.count()).alias("size"))))
        if not come.isEmpty():
            gain = materialize(self._gains(between, g, come.select("u", "v")), "gain")
            doubt.append(gain.select(F.col("node").alias("source")))
            bounds = bounds.join(gain, "node", "left").select("node", (F.col("most") + F.coalesce("gain", F.lit(0.0))).alias("most"), "exact")
        if doubt:
            unsure = reduce(DataFrame.union, doubt).distinct().select(F.col("source").alias("node"), F.lit(True).alias("unsure"))
            bounds = bounds.join(unsure, "node", "left").select("node", "most", (F.col("exact") & F.col("unsure").isNull()).alias("exact"))
        self._put(bounds)
        self._graph, self._result = g, self._settled(g)

    @staticmethod
    def _gains(before: Graph, after: Graph, arcs: DataFrame) -> DataFrame:
        """(node, gain) of the nodes that arcs(u, v) bring nearer to some v: no less than what they gain in all.

        A node t that comes nearer is reached by a last new arc (u, v) and j old hops, at the new distance of u, one and
        j; before, it was no farther than v and j.
        """
        from graphloom.operators.multisource import reach_counts

        to_u = _reaching(after, arcs.select(F.col("u").alias("node")).distinct()).select("node", F.col("end").alias("u"), F.col("distance").alias("du"))
        to_v = _reaching(before, arcs.select(F.col("v").alias("node")).distinct()).select("node", F.col("end").alias("v"), F.col("distance").alias("dv"))
        near = arcs.join(to_u, "u").join(to_v, ["node", "v"], "left").where("node <> v AND (dv IS NULL OR du + 1 < dv)")
        near = materialize(near.groupBy("node", "v", "dv").agg(F.min("du").alias("du")), "near")
        beyond = reach_counts(before, arcs.select(F.col("v").alias("id")).distinct()).select(F.col("source").alias("v"), "hop", "nodes")
        worth = F.col("nodes") * (1 / (F.col("du") + 1 + F.col("hop")) - F.coalesce(1 / (F.col("dv") + F.col("hop")), F.lit(0.0)))
        kinds = near.select("v", "du", "dv").distinct().join(beyond, "v").groupBy("v", "du", "dv").agg(F.sum(worth).alias("x"))
        same = (near["v"] == kinds["v"]) & (near["du"] == kinds["du"]) & near["dv"].eqNullSafe(kinds["dv"])
        return near.join(kinds, same).groupBy("node").agg(F.sum("x").alias("gain"))


class KeptKatz(Algorithm):
    """(node, lower, upper): bounds of the k greatest Katz centralities of a watched graph, greatest first, ties to smaller ids; walks of l steps count alpha^l, as top_katz has it.

    Kept are the numbers of walks of each length from each node. A batch changes those of one step at the arcs it
    brings or takes, and those of each further step at the arcs into what changed before: only these differences are
    joined with arcs. Lengths are added while the k best are not apart from the others, or by more than tol from their
    own bounds. alpha is 1 / (1 + the largest degree) unless given; where a batch brings a degree that alpha doesn't
    bear, all is counted anew if it wasn't given, and refused if it was. moved is the number of differences of the last batch.
    """

    def __init__(self, watched: Watched, k: int, alpha: float | None = None, tol: float = 1e-9, longest: int = 100):
        super().__init__(self._whole)
        self._watched, self._k, self._given, self._tol, self._longest, self.moved = watched, k, alpha, tol, longest, 0
        watched.register(self.update)

    def _top(self, g: Graph) -> int:
        return self._arcs.groupBy("u").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0

    def _read(self, g: Graph) -> None:
        self._graph, self._arcs = g, materialize(g.arcs().where("u <> v").select("u", "v").distinct(), "arcs")
        self._degree = self._top(g)

    def _whole(self) -> DataFrame:
        self._read(self._watched.graph)
        self._alpha = self._given or 1.0 / (1 + self._degree)
        if self._alpha * self._degree >= 1:
            raise ValueError(f"alpha must be below 1 / {self._degree}")
        self._walks = materialize(self._graph.vertices.select(F.col("id").alias("node"), F.array(F.lit(1.0)).alias("walks")), "walks")
        self._length = 0
        return self._settled()

    def _put(self, walks: DataFrame) -> None:
        old, self._walks = self._walks, materialize(walks, "walks")
        discard(old)

    def _onward(self, rows: DataFrame) -> DataFrame:
        """(node, x): sums of x of rows(node, x) over the arcs that lead to them."""
        return self._arcs.join(rows.select(F.col("node").alias("v"), "x"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("x").alias("x"))

    def _settled(self) -> DataFrame:
        a, top = self._alpha, self._degree
        while True:
            lower = F.expr(f"aggregate(walks, struct(0.0D AS s, 1.0D AS f), (m, x) -> struct(m.s + m.f * x AS s, m.f * {a!r}D AS f), m -> m.s)") - 1.0
            last = F.element_at("walks", -1) * float(a**self._length)
            bounded = self._walks.select("node", lower.alias("lower"), (lower + last * (a * top / (1 - a * top))).alias("upper"))
            best = bounded.orderBy(F.round("lower", 12).desc(), "node").limit(self._k + 1).collect()
            named = best[: self._k]
            rest = bounded.orderBy(F.desc("upper")).limit(self._k + 1).collect()
            others = max((r["upper"] for r in rest if r["node"] not in {b["node"] for b in named}), default=0.0)
            width = max((b["upper"] - b["lower"] for b in best), default=0.0)
            if width <= self._tol or self._length >= self._longest or (len(best) > self._k and named and named[-1]["lower"] >= others):
                return bounded.sparkSession.createDataFrame([(r["node"], r["lower"], r["upper"]) for r in named], "node long, lower double, upper double")
            more = self._onward(self._walks.select("node", F.element_at("walks", -1).alias("x")))
            self._put(self._walks.join(more, "node", "left").select("node", F.array_append("walks", F.coalesce("x", F.lit(0.0))).alias("walks")))
            self._length += 1

    def update(self, g: Graph, events: DataFrame) -> None:
        """The result after a batch; nothing before run()."""
        if not self.has_finished():
            return
        changed = changes(self._graph, g, events)
        fresh = materialize(g.vertices.select(F.col("id").alias("node")).join(self._walks, "node", "left_anti"), "fresh")
        stale, width = self._arcs, self._length + 1
        self._read(g)
        discard(stale)
        if self._alpha * self._degree >= 1:
            self._result = self._whole()
            return
        at = self._walks.select(F.col("node").alias("v"), "walks")
        moves = materialize(changed.join(at, "v").select(F.col("u").alias("node"), F.posexplode(F.transform("walks", lambda x: x * F.col("sign"))).alias("level", "x")), "moves")  # by old walks
        moves = moves.where(F.col("level") < self._length).select("node", (F.col("level") + 1).alias("level"), "x")
        steps = [materialize(fresh.select("node", F.lit(1.0).alias("x")), "step")]
        for level in range(1, width):
            here = self._onward(steps[-1]).union(moves.where(F.col("level") == level).select("node", "x"))
            steps.append(materialize(here.groupBy("node").agg(F.sum("x").alias("x")).where("x <> 0"), "step"))
        rows = reduce(DataFrame.union, [s.select("node", F.lit(i).alias("level"), "x") for i, s in enumerate(steps)])
        delta = materialize(rows.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("level", "x"))).alias("delta"), F.count("*").alias("k")), "delta")
        self.moved = delta.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        every = self._walks.join(g.vertices.select(F.col("id").alias("node")), "node", "left_semi").union(fresh.select("node", F.array_repeat(F.lit(0.0), width).alias("walks")))
        added = F.transform("walks", lambda x, i: x + F.coalesce(F.try_element_at(F.col("delta"), i), F.lit(0.0)))
        self._put(every.join(delta, "node", "left").select("node", F.when(F.col("delta").isNull(), F.col("walks")).otherwise(added).alias("walks")))
        discard(moves, delta, *steps)
        self._result = self._settled()
