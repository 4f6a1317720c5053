"""A graph of checked size as numpy rows, for algorithms that are sequential by nature, and its broadcast to per-source tasks."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph

#: Edges that may come to the driver or be broadcast (16 bytes an end and direction); larger graphs are refused, never cut.
MAX_EDGES = 20_000_000


class TooLarge(ValueError):
    """The graph exceeds what the driver may hold."""


class Csr:
    """ids[i] is the vertex of row i; row i has the neighbours nbr[ptr[i]:ptr[i + 1]] with weights w, and edge numbers eid."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, directed: bool):
        self.ids, self.directed = ids, directed
        self.src, self.dst, self.weight = np.searchsorted(ids, src), np.searchsorted(ids, dst), weight
        a, b, e = self.src, self.dst, np.arange(len(src))
        if not directed:
            other = a != b
            a, b, e = np.concatenate([a, b[other]]), np.concatenate([b, a[other]]), np.concatenate([e, e[other]])
        order = np.lexsort((e, b, a))
        self.row, self.nbr, self.eid = a[order], b[order], e[order]
        self.w = weight[self.eid]
        self.ptr = np.searchsorted(self.row, np.arange(len(ids) + 1))

    @property
    def n(self) -> int:
        return len(self.ids)

    @property
    def m(self) -> int:
        return len(self.src)

    def out(self, u: int) -> np.ndarray:
        return self.nbr[self.ptr[u] : self.ptr[u + 1]]

    def weights(self, u: int) -> np.ndarray:
        return self.w[self.ptr[u] : self.ptr[u + 1]]

    def edges_of(self, u: int) -> np.ndarray:
        return self.eid[self.ptr[u] : self.ptr[u + 1]]

    def degree(self) -> np.ndarray:
        return np.diff(self.ptr)

    def strength(self) -> np.ndarray:
        return np.bincount(self.row, self.w, self.n)

    def reversed(self) -> Csr:
        return Csr(self.ids, self.ids[self.dst], self.ids[self.src], self.weight, self.directed) if self.directed else self

    def index(self, ids: list[int]) -> list[int]:
        """Rows of vertices; unknown ones are an error."""
        at = np.searchsorted(self.ids, ids)
        if len(ids) and (at.max() >= self.n or (self.ids[at] != np.asarray(ids)).any()):
            raise ValueError("no such vertex")
        return at.tolist()

    def bfs(self, sources: list[int], reach: int | None = None) -> np.ndarray:
        """Hops from the nearest source; -1 where none leads."""
        dist = np.full(self.n, -1, dtype=np.int64)
        front = np.unique(np.asarray(sources, dtype=np.int64))
        dist[front] = 0
        hop = 0
        while len(front) and (reach is None or hop < reach):
            hop += 1
            front = self.around(front)
            front = front[dist[front] < 0]
            dist[front] = hop
        return dist

    def around(self, nodes: np.ndarray) -> np.ndarray:
        """Different neighbours of some nodes."""
        k = self.ptr[nodes + 1] - self.ptr[nodes]
        at = np.repeat(self.ptr[nodes] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return np.unique(self.nbr[at])

    def dijkstra(self, sources: list[int], heuristic: np.ndarray | None = None, target: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least weights (inf where none leads) and a predecessor of each node (-1 for none). A heuristic, never too large, orders the search for the target."""
        dist, pred, done = np.full(self.n, np.inf), np.full(self.n, -1, dtype=np.int64), np.zeros(self.n, dtype=bool)
        h = (lambda v: float(heuristic[v])) if heuristic is not None else (lambda v: 0.0)
        heap = []
        for s in sources:
            dist[s] = 0.0
            heapq.heappush(heap, (h(s), s))
        while heap:
            _, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u == target:
                break
            for v, x in zip(self.out(u).tolist(), self.weights(u).tolist(), strict=True):
                if dist[u] + x < dist[v]:
                    dist[v], pred[v] = dist[u] + x, u
                    heapq.heappush(heap, (dist[v] + h(v), v))
        return dist, pred

    def path(self, pred: np.ndarray, target: int) -> list[int]:
        out = [target]
        while pred[out[-1]] >= 0:
            out.append(int(pred[out[-1]]))
        return out[::-1]


def collect(g: Graph, limit: int | None = None) -> Csr:
    """The graph on the driver, after a count of its edges and vertices."""
    limit = MAX_EDGES if limit is None else limit
    g = g.materialized()
    m, n = g.edges.count(), g.vertices.count()
    if max(m, n) > limit:
        raise TooLarge(f"{n} vertices and {m} edges are more than the {limit} that this operator may hold in one place")
    ids = np.sort(g.vertices.select(F.col("id").cast("long")).toArrow().column(0).to_numpy())
    e = g.edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")).toArrow()
    src, dst, w = (e.column(i).to_numpy() for i in range(3))
    order = np.lexsort((w, dst, src))
    return Csr(ids.astype(np.int64), src[order], dst[order], w[order], g.directed)


def per_source(g: Graph, sources: DataFrame | None, kernel: Callable[[Csr, int], list[tuple]], schema: str, csr: Csr | None = None) -> DataFrame:
    """Rows of kernel(csr, row) for every source(id), None being all nodes; the graph is broadcast once, sources are dealt out."""
    spark = g.vertices.sparkSession
    ship = spark.sparkContext.broadcast(csr or collect(g))
    chosen = g.vertices.select("id") if sources is None else sources.select("id").distinct().join(g.vertices, "id", "left_semi")
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = ship.value
        for f in frames:
            rows: list[tuple] = []
            for u in c.index(f["id"].tolist()):
                rows += kernel(c, u)
            yield pd.DataFrame(rows, columns=names)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return chosen.repartition(parts, "id").mapInPandas(run, schema)


def frame(g: Graph, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a kernel's rows."""
    return g.vertices.sparkSession.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows], schema)
