"""Random and regular graphs. Those whose edges are functions of hashes and numbers are made by tasks, without a driver loop; those that grow edge by edge, or repair a degree sequence, are made on the driver up to MAX_LOCAL edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph

MAX_LOCAL = 20_000_000
#: Rows of an adjacency matrix whose edges a task draws at once.
BLOCK = 4096


def uniform(*key: Column | str | int) -> Column:
    """In [0, 1), by a hash of columns and numbers."""
    cols = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in key]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / float(1 << 52)


def _graph(spark: SparkSession, n: int, edges: DataFrame, directed: bool = False) -> Graph:
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).cast("double").alias("weight"))
    if not directed:
        e = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"), "weight")
    return Graph(spark.range(n), e, directed)


def _local(spark: SparkSession, n: int, pairs: np.ndarray, directed: bool = False) -> Graph:
    import pyarrow as pa

    p = np.asarray(pairs, dtype=np.int64).reshape(-1, 2)
    if len(p) > MAX_LOCAL:
        raise ValueError(f"more than {MAX_LOCAL} edges can't be made in one place")
    return _graph(spark, n, spark.createDataFrame(pa.table({"src": pa.array(p[:, 0]), "dst": pa.array(p[:, 1])}), "src long, dst long"), directed)


def _skips(rng: np.random.Generator, p: float, total: int) -> np.ndarray:
    """Numbers below total, each drawn with probability p, by geometric steps."""
    if p <= 0 or total <= 0:
        return np.zeros(0, dtype=np.int64)
    if p >= 1:
        return np.arange(total)
    out, at = [], -1
    while at < total:
        step = np.cumsum(rng.geometric(p, max(int(total * p * 1.1), 16))) + at
        out.append(step)
        at = int(step[-1])
    x = np.concatenate(out)
    return x[x < total]


def erdos_renyi(spark: SparkSession, n: int, p: float, directed: bool = False, loops: bool = False, seed: int = 1) -> Graph:
    """Each pair with probability p; a task draws the pairs of a block of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b in f["id"].tolist():
                rng, lo, hi = np.random.default_rng([seed, b]), b * BLOCK, min((b + 1) * BLOCK, n)
                rows = np.arange(lo, hi)
                width = np.full(hi - lo, n) if directed else rows + 1
                ends = np.cumsum(width)
                x = _skips(rng, p, int(ends[-1]))
                i = np.searchsorted(ends, x, "right")
                u, v = rows[i], x - (ends - width)[i]
                keep = np.ones(len(u), dtype=bool) if loops else u != v
                yield pd.DataFrame({"src": u[keep], "dst": v[keep]})

    return _graph(spark, n, spark.range(-(-n // BLOCK)).mapInPandas(run, "src long, dst long"), directed)


def block_model(spark: SparkSession, membership: list[int], affinity: list[list[float]], seed: int = 1) -> Graph:
    """Each pair with the probability of its blocks; a task draws the pairs of a block of rows with every group of columns."""
    own = np.asarray(membership)
    groups = [np.flatnonzero(own == k) for k in range(len(affinity))]
    ship = spark.sparkContext.broadcast((own, groups, affinity))
    n = len(own)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, groups, affinity = ship.value
        for f in frames:
            for b in f["id"].tolist():
                rng, rows = np.random.default_rng([seed, b]), np.arange(b * BLOCK, min((b + 1) * BLOCK, n))
                for k, mine in enumerate(groups):
                    mine = rows[own[rows] == k]
                    for j, others in enumerate(groups):
                        x = _skips(rng, affinity[k][j], len(mine) * len(others))
                        u, v = mine[x // max(len(others), 1)], others[x % max(len(others), 1)]
                        keep = u > v
                        yield pd.DataFrame({"src": u[keep], "dst": v[keep]})

    return _graph(spark, n, spark.range(-(-n // BLOCK)).mapInPandas(run, "src long, dst long"))


def clustered_random(spark: SparkSession, n: int, k: int, p_in: float, p_out: float, seed: int = 1) -> tuple[Graph, DataFrame]:
    """A graph of k random communities, and those (node, community)."""
    own = np.random.default_rng(seed).integers(0, k, n)
    g = block_model(spark, own.tolist(), [[p_in if i == j else p_out for j in range(k)] for i in range(k)], seed)
    return g, spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "node long, community long")


def rmat(spark: SparkSession, scale: int, edge_factor: int, a: float, b: float, c: float, d: float, weighted: bool = False, loops: bool = False, reduce_nodes: int = 0, seed: int = 1) -> Graph:
    """edge_factor * 2^scale draws of a quadrant per level, as columns; repeated edges become one, or its weight. reduce_nodes random nodes go."""
    if abs(a + b + c + d - 1) > 1e-9:
        raise ValueError("the four probabilities must add up to 1")
    n = 1 << scale
    x = [uniform("id", level, seed) for level in range(scale)]
    bit = lambda test: sum((F.when(test(x[level]), 1 << level).otherwise(0) for level in range(scale)), F.lit(0)).cast("long")
    e = spark.range(n * edge_factor).select(bit(lambda r: r >= a + b).alias("src"), bit(lambda r: ((r >= a) & (r < a + b)) | (r >= a + b + c)).alias("dst"))
    e = e if loops else e.where("src <> dst")
    e = e.groupBy(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    g = _graph(spark, n, e if weighted else e.withColumn("weight", F.lit(1.0)))
    if not reduce_nodes:
        return g
    from graphloom.operators.toolbox import compacted, remove_nodes

    return compacted(remove_nodes(g, g.vertices.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(reduce_nodes)))


def ring_lattice(spark: SparkSession, n: int, k: int) -> Graph:
    """Each node with the next k, at most (n - 1) / 2 of them."""
    k = min(k, (n - 1) // 2)
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j")) if k > 0 else spark.range(0).select(F.col("id").alias("src"), F.lit(1).alias("j"))
    return _graph(spark, n, e.select("src", ((F.col("src") + F.col("j")) % n).alias("dst")))


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 1) -> Graph:
    """A ring lattice whose edges get, with probability p, a random second end; edges that come twice this way are one."""
    e = ring_lattice(spark, n, k).edges
    other = F.floor(uniform("src", "dst", 2, seed) * n).cast("long")
    far = e.select("src", F.when(uniform("src", "dst", 1, seed) < p, other).otherwise(F.col("dst")).alias("dst")).where("src <> dst")
    g = _graph(spark, n, far)
    return Graph(g.vertices, g.edges.dropDuplicates(["src", "dst"]))


def barabasi_albert(spark: SparkSession, k: int, n: int, seed: int = 1) -> Graph:
    """Preferential attachment: draw 2i + 1 of a list of edge ends is that of a random earlier place, which a task follows back by hashes until it meets an even place, whose node is known."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            i = f["id"].to_numpy().astype(np.uint64)
            place = (2 * i + 1).astype(np.uint64)
            while (odd := place % np.uint64(2) == 1).any():
                with np.errstate(over="ignore"):
                    h = place[odd] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(32)
                place[odd] = h % place[odd]
            yield pd.DataFrame({"src": (i // np.uint64(k)).astype(np.int64) + 1, "dst": (place // np.uint64(2 * k)).astype(np.int64)})

    e = spark.range(k * max(n - 1, 0)).mapInPandas(run, "src long, dst long").where("src <> dst")
    g = _graph(spark, n, e)
    return Graph(g.vertices, g.edges.dropDuplicates(["src", "dst"]))


def chung_lu(spark: SparkSession, degrees: list[int], seed: int = 1) -> Graph:
    """Pairs with probability du dv / sum (1 at most); nodes sorted by degree, each row drawn in steps of falling probability in a task. ids are places in the list."""
    d = np.asarray(degrees, dtype=float)
    order = np.argsort(-d, kind="stable")
    ship = spark.sparkContext.broadcast((d[order], order))
    total = max(d.sum(), 1e-300)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, order = ship.value
        for f in frames:
            for b in f["id"].tolist():
                rng, src, dst = np.random.default_rng([seed, b]), [], []
                for u in range(b * BLOCK, min((b + 1) * BLOCK, len(w))):
                    v = u + 1
                    while v < len(w):
                        p = min(w[u] * w[v] / total, 1.0)
                        if p <= 0:
                            break
                        v += int(rng.geometric(p)) - 1 if p < 1 else 0
                        if v < len(w):
                            if rng.random() < min(w[u] * w[v] / total, 1.0) / p:
                                src.append(order[u])
                                dst.append(order[v])
                            v += 1
                yield pd.DataFrame({"src": np.array(src, dtype=np.int64), "dst": np.array(dst, dtype=np.int64)})

    return _graph(spark, len(d), spark.range(-(-len(d) // BLOCK)).mapInPandas(run, "src long, dst long"))


def chung_lu_by_classes(spark: SparkSession, degrees: list[int], seed: int = 1) -> Graph:
    """The same, by classes of equal degree: each pair of classes is a block of one probability."""
    d = np.asarray(degrees)
    classes, own = np.unique(d, return_inverse=True)
    total = max(float(d.sum()), 1e-300)
    p = np.minimum(np.outer(classes, classes) / total, 1.0)
    return block_model(spark, own.tolist(), p.tolist(), seed)


def realizable(degrees: list[int]) -> bool:
    """Erdős and Gallai's test."""
    d = np.sort(np.asarray(degrees, dtype=np.int64))[::-1]
    if not len(d):
        return True
    if d.sum() % 2 or d[-1] < 0 or d[0] >= len(d):
        return False
    k = np.arange(1, len(d) + 1)
    return bool((np.cumsum(d) <= k * (k - 1) + np.array([np.minimum(d[i:], i).sum() for i in k])).all())


def havel_hakimi(spark: SparkSession, degrees: list[int], ignore: bool = False) -> Graph:
    """A simple graph of this degree sequence; one that has none is an error, or is met as far as it goes."""
    import heapq

    if not ignore and not realizable(degrees):
        raise ValueError("no simple graph has these degrees")
    heap = [(-d, u) for u, d in enumerate(degrees) if d > 0]
    heapq.heapify(heap)
    pairs = []
    while heap:
        d, u = heapq.heappop(heap)
        near = [heapq.heappop(heap) for _ in range(min(-d, len(heap)))]
        for e, v in near:
            pairs.append((u, v))
            if e + 1 < 0:
                heapq.heappush(heap, (e + 1, v))
    return _local(spark, len(degrees), np.array(pairs))


def configuration_model(spark: SparkSession, degrees: list[int], seed: int = 1) -> Graph:
    """A random simple graph of exactly this degree sequence: a first one, then edge switches."""
    from graphloom.operators.randomize import edge_switching

    return edge_switching(havel_hakimi(spark, degrees), 10.0, seed)


def power_law_degrees(n: int, low: int, high: int, gamma: float = -2.0, seed: int = 1) -> list[int]:
    """n degrees from low to high with probability d^gamma, their sum even."""
    x = np.arange(low, high + 1)
    p = x.astype(float) ** gamma
    d = np.random.default_rng(seed).choice(x, n, p=p / p.sum())
    if d.sum() % 2:
        d[np.argmin(d)] += 1
    return d.tolist()


def dorogovtsev_mendes(spark: SparkSession, n: int, seed: int = 1) -> Graph:
    """From a triangle on, each new node is linked to both ends of a random edge."""
    rng, e = np.random.default_rng(seed), [(0, 1), (1, 2), (0, 2)][: 3 if n > 2 else max(n - 1, 0)]
    for u in range(3, n):
        a, b = e[int(rng.integers(len(e)))]
        e += [(u, a), (u, b)]
    return _local(spark, n, np.array(e))


def lfr(spark: SparkSession, n: int, low: int = 10, high: int = 50, gamma: float = -2.0, least: int = 20, most: int = 100, beta: float = -1.0, mu: float = 0.2, seed: int = 1) -> tuple[Graph, DataFrame]:
    """A benchmark of power-law degrees and community sizes: each node has 1 - mu of its edges inside. Both parts are made simple by switches; an edge that both have counts once."""
    rng = np.random.default_rng(seed)
    d = np.array(power_law_degrees(n, low, high, gamma, seed))
    inner = np.round(d * (1 - mu)).astype(int)
    sizes: list[int] = []
    while sum(sizes) < n:
        x = np.arange(least, most + 1)
        p = x.astype(float) ** beta
        sizes.append(int(rng.choice(x, p=p / p.sum())))
    sizes[-1] -= sum(sizes) - n
    if sizes[-1] < least and len(sizes) > 1:
        rest = sizes.pop()
        for i in range(rest):
            sizes[i % len(sizes)] += 1
    own, room = np.full(n, -1), np.array(sizes)
    for u in np.argsort(-inner, kind="stable").tolist():
        fit = np.flatnonzero((room > 0) & (np.array(sizes) > inner[u]))
        fit = fit if len(fit) else np.flatnonzero(room > 0)
        k = int(rng.choice(fit))
        own[u] = k
        room[k] -= 1
        inner[u] = min(inner[u], sizes[k] - 1)
    pairs: set[tuple[int, int]] = set()

    def link(nodes: np.ndarray, want: np.ndarray, apart: bool) -> None:
        stubs = np.repeat(nodes, want)
        for _ in range(50):
            rng.shuffle(stubs)
            if len(stubs) % 2:
                stubs = stubs[:-1]
            a, b = stubs[::2], stubs[1::2]
            left = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                k = (max(x, y), min(x, y))
                if x == y or k in pairs or (apart and own[x] == own[y]):
                    left += [x, y]
                else:
                    pairs.add(k)
            stubs = np.array(left, dtype=np.int64)
            if len(stubs) < 2:
                break

    for k in range(len(sizes)):
        nodes = np.flatnonzero(own == k)
        link(nodes, inner[nodes], False)
    link(np.arange(n), d - inner, True)
    return _local(spark, n, np.array(sorted(pairs))), spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "node long, community long")


# geometric graphs


def hyperbolic_distance(r1: np.ndarray, a1: np.ndarray, r2: np.ndarray, a2: np.ndarray) -> np.ndarray:
    turn = np.pi - np.abs(np.pi - np.abs(a1 - a2))
    return np.arccosh(np.maximum(np.cosh(r1) * np.cosh(r2) - np.sinh(r1) * np.sinh(r2) * np.cos(turn), 1.0))


def hyperbolic_points(n: int, degree: float, gamma: float = 3.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Radii, angles and the radius of a disk in which n points have this mean degree, about."""
    alpha = (gamma - 1) / 2
    xi = alpha / (alpha - 0.5) if alpha > 0.5 else 2.0
    size = 2 * np.log(2 * n * xi * xi / (np.pi * max(degree, 1e-9)))
    rng = np.random.default_rng(seed)
    r = np.arccosh(1 + (np.cosh(alpha * size) - 1) * rng.random(n)) / alpha
    return r, rng.random(n) * 2 * np.pi, float(size)


def hyperbolic(spark: SparkSession, n: int, degree: float = 6, gamma: float = 3.0, temperature: float = 0.0, seed: int = 1) -> Graph:
    """Points of a hyperbolic disk, linked if they are nearer than its radius (or with a probability that falls with distance, at a temperature). Points in bands of the radius, sorted by angle, are broadcast; a task searches the bands for its points."""
    r, a, size = hyperbolic_points(n, degree, gamma, seed)
    return hyperbolic_of(spark, r, a, size, temperature, seed)


def hyperbolic_of(spark: SparkSession, r: np.ndarray, a: np.ndarray, size: float, temperature: float = 0.0, seed: int = 1) -> Graph:
    edges = np.linspace(0, size, max(int(size), 2) + 1)
    band = np.clip(np.searchsorted(edges, r, "right") - 1, 0, len(edges) - 2)
    bands = []
    for k in range(len(edges) - 1):
        at = np.flatnonzero(band == k)
        at = at[np.argsort(a[at])]
        bands.append((at, a[at]))
    ship = spark.sparkContext.broadcast((r, a, bands, edges))
    reach = size if temperature == 0 else size * (1 + 4 * temperature)  # beyond, the probability is below exp(-2 size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, a, bands, edges = ship.value
        for f in frames:
            src, dst = [], []
            for u in f["id"].tolist():
                for (at, angle), low in zip(bands, edges[:-1], strict=True):
                    x = 1.0
                    if r[u] > 0 and low > 0:
                        x = (np.cosh(r[u]) * np.cosh(low) - np.cosh(reach)) / (np.sinh(r[u]) * np.sinh(low))
                    width = np.pi if r[u] == 0 or low == 0 or x < -1 else np.arccos(min(x, 1.0))
                    if width >= np.pi:
                        near = at
                    else:
                        lo, hi = a[u] - width, a[u] + width
                        i, j = np.searchsorted(angle, [lo, hi])
                        near = at[i:j]
                        if lo < 0:
                            near = np.concatenate([near, at[np.searchsorted(angle, lo + 2 * np.pi) :]])
                        if hi > 2 * np.pi:
                            near = np.concatenate([near, at[: np.searchsorted(angle, hi - 2 * np.pi)]])
                    near = near[near < u]
                    d = hyperbolic_distance(r[u], a[u], r[near], a[near])
                    if temperature == 0:
                        near = near[d <= size]
                    else:
                        p = 1 / (1 + np.exp(np.minimum((d - size) / (2 * temperature), 700)))
                        near = near[np.random.default_rng([seed, u, int(low * 1000)]).random(len(near)) < p]
                    src += [u] * len(near)
                    dst += near.tolist()
            yield pd.DataFrame({"src": np.array(src, dtype=np.int64), "dst": np.array(dst, dtype=np.int64)})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return _graph(spark, len(r), spark.range(0, len(r), 1, parts * 4).mapInPandas(run, "src long, dst long"))


def _cells(x: np.ndarray, size: float) -> dict[tuple[int, ...], list[int]]:
    cells: dict[tuple[int, ...], list[int]] = {}
    for i, c in enumerate(map(tuple, np.floor(x / size).astype(int).tolist())):
        cells.setdefault(c, []).append(i)
    return cells


def pub_web(spark: SparkSession, n: int, areas: int = 10, radius: float = 0.1, most: int = 20, seed: int = 1) -> Graph:
    """Points in dense areas of the unit torus, linked to at most so many nearest ones within a radius."""
    rng = np.random.default_rng(seed)
    x = _dense_points(n, areas, rng)
    return _local(spark, n, _near_pairs(x, radius, most))


def _dense_points(n: int, areas: int, rng: np.random.Generator) -> np.ndarray:
    centre, spread = rng.random((areas, 2)), rng.random(areas) * 0.1 + 0.02
    k = rng.integers(0, areas + 1, n)  # the last is all over
    return np.where((k == areas)[:, None], rng.random((n, 2)), centre[np.minimum(k, areas - 1)] + rng.normal(size=(n, 2)) * spread[np.minimum(k, areas - 1)][:, None]) % 1.0


def _near_pairs(x: np.ndarray, radius: float, most: int) -> np.ndarray:
    side = max(int(1 / radius), 1)
    cells, pairs = _cells(x, 1 / side), set()
    for i in range(len(x)):
        c = np.minimum(np.floor(x[i] * side).astype(int), side - 1)
        near = {j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get(((c[0] + dx) % side, (c[1] + dy) % side), [])} - {i}
        at = np.array(sorted(near), dtype=int)
        if len(at):
            d = np.abs(x[at] - x[i])
            d = np.sqrt((np.minimum(d, 1 - d) ** 2).sum(axis=1))
            at = at[np.lexsort((at, d))][: int((d <= radius).sum())][:most]
            pairs |= {(max(i, j), min(i, j)) for j in at.tolist()}
    return np.array(sorted(pairs))


def mocnik(spark: SparkSession, dim: int, n: int, k: float, seed: int = 1) -> Graph:
    """Directed: each of n points of the unit cube leads to all within k times the distance of its nearest one."""
    x = np.random.default_rng(seed).random((n, dim))
    return _local(spark, n, _mocnik_pairs(x, k, 0), True)


def mocnik_layers(spark: SparkSession, dim: int, ns: list[int], ks: list[float], seed: int = 1) -> Graph:
    """The same in several layers, in each of which the first points of the list so far take part."""
    x = np.random.default_rng(seed).random((sum(ns), dim))
    parts = [_mocnik_pairs(x[: sum(ns[: i + 1])], k, 0) for i, k in enumerate(ks)]
    g = _local(spark, len(x), np.concatenate(parts), True)
    return Graph(g.vertices, g.edges.dropDuplicates(["src", "dst"]), True)


def _mocnik_pairs(x: np.ndarray, k: float, first: int) -> np.ndarray:
    out, n = [], len(x)
    for lo in range(0, n, 512):
        d = np.sqrt(((x[lo : lo + 512, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        i, j = np.nonzero(d <= k * d.min(axis=1, keepdims=True))
        out.append(np.stack([i + lo + first, j + first], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2))


# streams of events


def _events(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, type string, u long, v long, w double")


def path_events(spark: SparkSession, steps: int) -> DataFrame:
    """A path that grows by a node and an edge each step."""
    rows: list[tuple] = [("NODE_ADDITION", 0, None, None)]
    for i in range(1, steps + 1):
        rows += [("NODE_ADDITION", i, None, None), ("EDGE_ADDITION", i - 1, i, 1.0), ("TIME_STEP", None, None, None)]
    return _events(spark, rows)


def barabasi_albert_events(spark: SparkSession, steps: int, k: int = 2, seed: int = 1) -> DataFrame:
    """A new node each step, with k edges to different nodes by degree."""
    rng, ends = np.random.default_rng(seed), [0]
    rows: list[tuple] = [("NODE_ADDITION", 0, None, None)]
    for u in range(1, steps + 1):
        rows.append(("NODE_ADDITION", u, None, None))
        to: set[int] = set()
        while len(to) < min(k, u):
            to.add(ends[int(rng.integers(len(ends)))])
        for v in sorted(to):
            rows.append(("EDGE_ADDITION", u, v, 1.0))
            ends += [u, v]
        rows.append(("TIME_STEP", None, None, None))
    return _events(spark, rows)


def dorogovtsev_mendes_events(spark: SparkSession, steps: int, seed: int = 1) -> DataFrame:
    rng, e = np.random.default_rng(seed), [(0, 1), (1, 2), (0, 2)]
    rows: list[tuple] = [("NODE_ADDITION", i, None, None) for i in range(3)] + [("EDGE_ADDITION", a, b, 1.0) for a, b in e]
    for u in range(3, 3 + steps):
        a, b = e[int(rng.integers(len(e)))]
        e += [(u, a), (u, b)]
        rows += [("NODE_ADDITION", u, None, None), ("EDGE_ADDITION", u, a, 1.0), ("EDGE_ADDITION", u, b, 1.0), ("TIME_STEP", None, None, None)]
    return _events(spark, rows)


def forest_fire_events(spark: SparkSession, steps: int, p: float = 0.3, directed: bool = False, r: float = 1.0, seed: int = 1) -> DataFrame:
    """Each new node links to a random one and on to what burns from there: geometric numbers of its neighbours, in-neighbours with p times r."""
    rng, out, into = np.random.default_rng(seed), {0: set()}, {0: set()}
    rows: list[tuple] = [("NODE_ADDITION", 0, None, None)]
    for u in range(1, steps + 1):
        rows.append(("NODE_ADDITION", u, None, None))
        start = int(rng.integers(u))
        seen, queue = {start}, [start]
        for x in queue:
            for side, q in ((out, p), (into, p * r)):
                near = sorted(side[x] - seen)
                for v in rng.permutation(near)[: rng.geometric(1 - q) - 1].tolist() if near else []:
                    seen.add(v)
                    queue.append(v)
        out[u], into[u] = set(), set()
        for v in queue:
            rows.append(("EDGE_ADDITION", u, v, 1.0))
            out[u].add(v)
            into[v].add(u)
            if not directed:
                out[v].add(u)
                into[u].add(v)
        rows.append(("TIME_STEP", None, None, None))
    return _events(spark, rows)


def _changes(before: set[tuple[int, int]], after: set[tuple[int, int]]) -> list[tuple]:
    rows = [("EDGE_REMOVAL", a, b, None) for a, b in sorted(before - after)] + [("EDGE_ADDITION", a, b, 1.0) for a, b in sorted(after - before)]
    return [*rows, ("TIME_STEP", None, None, None)]


def hyperbolic_events(spark: SparkSession, n: int, degree: float, steps: int, share: float = 0.1, distance: float = 0.1, seed: int = 1) -> DataFrame:
    """Points of a hyperbolic disk, a share of which moves by an angle each step."""
    r, a, size = hyperbolic_points(n, degree, 3.0, seed)
    rng = np.random.default_rng(seed + 1)

    def links(a: np.ndarray) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        for u in range(n):
            v = np.flatnonzero(hyperbolic_distance(r[u], a[u], r[:u], a[:u]) <= size)
            out |= {(u, int(x)) for x in v}
        return out

    now = links(a)
    rows: list[tuple] = [("NODE_ADDITION", i, None, None) for i in range(n)] + _changes(set(), now)
    for _ in range(steps):
        a = np.where(rng.random(n) < share, (a + rng.choice([-1, 1], n) * distance) % (2 * np.pi), a)
        new = links(a)
        rows += _changes(now, new)
        now = new
    return _events(spark, rows)


def pub_web_events(spark: SparkSession, n: int, steps: int, areas: int = 10, radius: float = 0.1, most: int = 20, seed: int = 1) -> DataFrame:
    """A geometric graph some of whose points are placed anew each step."""
    rng = np.random.default_rng(seed)
    x = _dense_points(n, areas, rng)
    pairs = lambda: {(int(a), int(b)) for a, b in _near_pairs(x, radius, most)}
    now = pairs()
    rows: list[tuple] = [("NODE_ADDITION", i, None, None) for i in range(n)] + _changes(set(), now)
    for _ in range(steps):
        go = rng.random(n) < 0.05
        x[go] = rng.random((int(go.sum()), 2))
        new = pairs()
        rows += _changes(now, new)
        now = new
    return _events(spark, rows)
