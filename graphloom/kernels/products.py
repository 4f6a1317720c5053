"""Products of a graph's arcs with a vector, round after round: arcs are cut into a grid of blocks and written once, bucketed by block; a round moves as many copies of the vector as the grid has rows, and no arcs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.scratch import discard, materialize, scratch_dir

#: Arcs of a block at most, but for chance, and of a row of it.
BLOCK, ROW = 20_000_000, 1_000_000


def _flat(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name).combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
    return c.flatten().to_numpy(zero_copy_only=False)


def _one(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _places(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where in sorted ids each x lies; -1 where it doesn't."""
    if not len(ids):
        return np.full(len(x), -1, dtype=np.int32)
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return np.where(ids[at] == x, at, -1).astype(np.int32)


class Products:
    """Vectors are tables (part, one list for each name) of a row per part of the nodes, in the order of the part's ids."""

    def __init__(self, g: Graph):
        spark, arcs = g.vertices.sparkSession, g.arcs()
        m = g.edges.count() * (1 if g.directed else 2)
        self.spark = spark
        self.k = k = max(-int(-((m / BLOCK) ** 0.5) // 1), min(8, 1 + int((m / 1_000_000) ** 0.5)))
        # a name for each block, so that every bucket holds one: buckets go by F.hash
        names = spark.range(40 * k * k).select(F.col("id").cast("int").alias("p")).groupBy(F.pmod(F.hash("p"), F.lit(k * k)).alias("b")).agg(F.min("p").alias("p"))
        self.name = [r.p for r in names.orderBy("b").collect()]
        part = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(k)).cast("int")
        self.part = part
        ids = g.vertices.select(F.col("id").cast("long").alias("id")).distinct()
        self.ids = materialize(ids.groupBy(part("id").alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids")), "ids")
        self.size = {r.part: r.n for r in self.ids.select("part", F.size("ids").alias("n")).collect()}
        name = F.array(*[F.lit(x) for x in self.name])
        row = arcs.select(name[part("u") * k + part("v")].alias("p"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
        each = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        u = self.ids.select("part", "ids", each.alias("o")).select(name[F.col("part") * k + F.col("o")].alias("p"), F.lit(0).alias("side"), "ids")
        v = self.ids.select("part", "ids", each.alias("o")).select(name[F.col("o") * k + F.col("part")].alias("p"), F.lit(1).alias("side"), "ids")

        def cut(a: pa.Table, held: pa.Table) -> pa.Table:
            sides = {x: np.zeros(0, dtype=np.int64) for x in (0, 1)}
            for i in range(held.num_rows):
                sides[held.column("side")[i].as_py()] = _flat(held.slice(i, 1), "ids")
            at = [_places(sides[s], a.column(c).to_numpy()) for s, c in enumerate("uv")]
            known = (at[0] >= 0) & (at[1] >= 0)  # arcs from or to what is no vertex carry nothing
            n = int(known.sum())
            ends = pa.array(np.append(np.arange(0, n, ROW), n).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[known])) for x in (*at, a.column("w").to_numpy())]
            return pa.table([pa.array([a.column("p")[0].as_py() if n else 0] * len(lists[0]), pa.int32()), *lists], names=["p", "u", "v", "w"])

        blocks = row.repartition(k * k, "p").groupBy("p").cogroup(u.union(v).groupBy("p")).applyInArrow(cut, "p int, u array<int>, v array<int>, w array<double>")
        self.table, self.path = f"graphloom_{uuid.uuid4().hex}", f"{scratch_dir(spark)}/blocks-{uuid.uuid4().hex}"
        blocks.write.bucketBy(k * k, "p").sortBy("p").option("path", self.path).saveAsTable(self.table)
        self.blocks = spark.table(self.table)

    def vector(self, values: DataFrame, *names: str) -> DataFrame:
        """Of values(id, names), one row a vertex."""
        both = F.sort_array(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), *[F.col(n).cast("double").alias(n) for n in names])))
        return materialize(values.groupBy(self.part("id").alias("part")).agg(both.alias("l")).select("part", *[F.col(f"l.{n}").alias(n) for n in names]), "vector")

    def step(self, state: DataFrame, names: tuple[str, ...], sent: Callable, update: Callable) -> DataFrame:
        """The state, a vector of names, after a round: sent(state) goes along the arcs, times their weights, and update(sums, state) gives the new lists; both get lists by name. Further columns: change and square, sums over each part of |x - before| and x * x, x being the first name."""
        k, name, size = self.k, self.name, self.size
        to = {p: i % k for i, p in enumerate(name)}

        def give(t: pa.Table) -> pa.Table:
            return pa.table({"part": t.column("part"), "x": _one(sent({n: _flat(t, n) for n in names}))})

        def along(a: pa.Table, held: pa.Table) -> pa.Table:
            if not a.num_rows or not held.num_rows:
                return pa.table({"part": pa.array([], pa.int32()), "turn": pa.array([], pa.int32()), "s": pa.array([], pa.list_(pa.float64()))})
            j = to[held.column("p")[0].as_py()]
            s = np.bincount(_flat(a, "v"), _flat(a, "w") * _flat(held, "x")[_flat(a, "u")], size[j])
            return pa.table({"part": pa.array([j], pa.int32()), "turn": pa.array([held.column("turn")[0].as_py()], pa.int32()), "s": _one(s)})

        def renew(got: pa.Table, t: pa.Table) -> pa.Table:
            own, s = {n: _flat(t, n) for n in names}, np.zeros(size[t.column("part")[0].as_py()])
            for i in np.argsort(got.column("turn").to_numpy()):  # always in the same order
                s += _flat(got.slice(int(i), 1), "s")
            new = {**own, **update(s, own)}
            x = new[names[0]]
            return pa.table({"part": t.column("part"), **{n: _one(new[n]) for n in names}, "change": [float(np.abs(x - own[names[0]]).sum())], "square": [float((x * x).sum())]})

        out = state.select("part", *names).groupBy("part").applyInArrow(give, "part int, x array<double>")
        out = out.select("part", "x", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("o"))
        out = out.select(F.array(*[F.lit(x) for x in name])[F.col("part") * k + F.col("o")].alias("p"), F.col("part").alias("turn"), "x")
        sums = self.blocks.groupBy("p").cogroup(out.groupBy("p")).applyInArrow(along, "part int, turn int, s array<double>")
        lists = ", ".join(f"{n} array<double>" for n in names)
        return materialize(sums.groupBy("part").cogroup(state.select("part", *names).groupBy("part")).applyInArrow(renew, f"part int, {lists}, change double, square double"), "vector")

    def values(self, state: DataFrame, name: str) -> DataFrame:
        """(id, x): the vector by vertex."""
        both = self.ids.join(state.select("part", F.col(name).alias("x")), "part").select(F.explode(F.arrays_zip("ids", "x")).alias("z"))
        return both.select(F.col("z.ids").alias("id"), F.col("z.x").alias("x"))

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.blocks._scratch_path = self.path
        discard(self.blocks)
