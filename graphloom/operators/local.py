"""Communities around seeds, by greedy expansion, push and sweep, cliques and triangles.

Each seed is a task of its own over a broadcast graph of checked size; approximate personal PageRank
also runs as relational rounds. Ties go to the smaller id. Loops are left out of the counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.kernels.csr import Csr, per_source

Kernel = Callable[[Csr, int], set[int]]
SCHEMA = "seed long, node long"


class Shell:
    """A node set with the weight inside it, across its border, and from each outer neighbour to it."""

    def __init__(self, c: Csr, nodes: set[int]):
        self.c, self.own, self.inner, self.cut, self.near = c, set(), 0.0, 0.0, {}
        for u in sorted(nodes):
            self.add(u)

    def around(self, u: int) -> list[tuple[int, float]]:
        return [(v, w) for v, w in zip(self.c.out(u).tolist(), self.c.weights(u).tolist(), strict=True) if v != u]

    def split(self, u: int) -> tuple[float, float]:
        """Weight from u into the set, and to others."""
        a = self.around(u)
        inside = sum(w for v, w in a if v in self.own)
        return inside, sum(w for _, w in a) - inside

    def add(self, u: int) -> None:
        inside, out = self.split(u)
        self.own.add(u)
        self.near.pop(u, None)
        self.inner += inside
        self.cut += out - inside
        for v, w in self.around(u):
            if v not in self.own:
                self.near[v] = self.near.get(v, 0.0) + w

    def remove(self, u: int) -> None:
        self.own.discard(u)
        inside, out = self.split(u)
        self.inner -= inside
        self.cut += inside - out
        for v, w in self.around(u):
            if v not in self.own:
                self.near[v] = self.near.get(v, 0.0) - w
                if self.near[v] <= 1e-12:
                    del self.near[v]
        if inside:
            self.near[u] = inside

    def border(self) -> int:
        """Members with outer neighbours."""
        return sum(any(v not in self.own for v, _ in self.around(u)) for u in self.own)


def _rows(c: Csr, seed: int, found: set[int]) -> list[tuple]:
    return [(int(c.ids[seed]), int(c.ids[v])) for v in sorted(found)]


def detected(g: Graph, seeds: DataFrame, kernel: Kernel) -> DataFrame:
    """(seed, node) of the kernel's community around each of seeds(id)."""
    return per_source(g, seeds, lambda c, u: _rows(c, u, kernel(c, u)), SCHEMA)


def greedy(objective: str = "M") -> Kernel:
    """Adds the outer neighbour that raises the objective most, while any does: M = inner / cut, L = 2 inner border / (size cut)."""

    def value(inner: float, cut: float, size: int, border: int) -> float:
        if cut <= 1e-12:
            return np.inf
        return inner / cut if objective == "M" else 2 * inner * border / (size * cut)

    def kernel(c: Csr, seed: int) -> set[int]:
        s = Shell(c, {seed})
        now = value(s.inner, s.cut, 1, s.border())
        while s.near:
            best = None
            for v in sorted(s.near):
                inside, out = s.split(v)
                border = 0
                if objective != "M":
                    t = Shell(c, s.own | {v})
                    border = t.border()
                q = value(s.inner + inside, s.cut + out - inside, len(s.own) + 1, border)
                if q > now + 1e-12 and (best is None or q > best[0] + 1e-12):
                    best = (q, v)
            if best is None:
                break
            now = best[0]
            s.add(best[1])
        return s.own

    return kernel


def fitness(alpha: float = 1.0) -> Kernel:
    """Adds by f = 2 inner / (2 inner + cut)^alpha and, after each step, takes off members but the seed that lower f."""

    def f(inner: float, cut: float) -> float:
        return 2 * inner / max(2 * inner + cut, 1e-300) ** alpha

    def kernel(c: Csr, seed: int) -> set[int]:
        s = Shell(c, {seed})
        for _ in range(10 * c.n):
            now, best = f(s.inner, s.cut), None
            for v in sorted(s.near):
                inside, out = s.split(v)
                q = f(s.inner + inside, s.cut + out - inside)
                if q > now + 1e-12 and (best is None or q > best[0] + 1e-12):
                    best = (q, v)
            if best is None:
                break
            s.add(best[1])
            while True:
                now, worst = f(s.inner, s.cut), None
                for u in sorted(s.own - {seed}):
                    inside, out = s.split(u)
                    q = f(s.inner - inside, s.cut + inside - out)
                    if q > now + 1e-12 and (worst is None or q > worst[0]):
                        worst = (q, u)
                if worst is None:
                    break
                s.remove(worst[1])
        return s.own

    return kernel


def border_sharpness() -> Kernel:
    """Adds the outer neighbour by T: of the edges at border members, the share that stays inside."""

    def t(s: Shell) -> float:
        inside = outside = 0.0
        edges: set[tuple[int, int]] = set()
        for u in s.own:
            near = s.around(u)
            if any(v not in s.own for v, _ in near):
                for v, w in near:
                    if v not in s.own:
                        outside += w
                    elif (min(u, v), max(u, v)) not in edges:
                        edges.add((min(u, v), max(u, v)))
                        inside += w
        return inside / (inside + outside) if inside + outside else 1.0

    def kernel(c: Csr, seed: int) -> set[int]:
        s = Shell(c, {seed})
        now = t(s)
        while s.near:
            best = None
            for v in sorted(s.near):
                q = t(Shell(c, s.own | {v}))
                if q > now + 1e-12 and (best is None or q > best[0] + 1e-12):
                    best = (q, v)
            if best is None:
                break
            now = best[0]
            s.add(best[1])
        return s.own

    return kernel


def _similar(c: Csr, u: int, v: int) -> float:
    """Cosine of the weighted closed neighbourhoods."""
    a = dict(zip(c.out(u).tolist(), c.weights(u).tolist(), strict=True)) | {u: 1.0}
    b = dict(zip(c.out(v).tolist(), c.weights(v).tolist(), strict=True)) | {v: 1.0}
    dot = sum(w * b[x] for x, w in a.items() if x in b)
    return dot / np.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def tightness(alpha: float = 1.0) -> Kernel:
    """Adds the outer neighbour most similar to the set while the tightness gain is positive: similarity lost outside over what is left, less the set's ratio times alpha."""

    def kernel(c: Csr, seed: int) -> set[int]:
        sim: dict[tuple[int, int], float] = {}

        def of(u: int, v: int) -> float:
            k = (min(u, v), max(u, v))
            if k not in sim:
                sim[k] = _similar(c, *k)
            return sim[k]

        own, inner, outer = {seed}, 0.0, sum(of(seed, v) for v in c.out(seed).tolist() if v != seed)
        refused: set[int] = set()
        while True:
            near = sorted({v for u in own for v in c.out(u).tolist()} - own - refused)
            if not near:
                return own
            to = {v: (sum(of(u, v) for u in c.out(v).tolist() if u in own), sum(of(u, v) for u in c.out(v).tolist() if u not in own and u != v)) for v in near}
            v = max(near, key=lambda x: (to[x][0], -x))
            inside, out = to[v]
            gain = outer / max(inner, 1e-12) - (alpha * out - inside) / max(2 * inside, 1e-12) if inner else 1.0
            if gain > 0:
                own.add(v)
                inner += 2 * inside
                outer += out - inside
            else:
                refused.add(v)

    return kernel


def triangles_first(refine: bool = False, jaccard: bool = False) -> Kernel:
    """Adds the outer neighbour with the best score, triangles with the set (or the Jaccard index) over its degree, while the set's conductance falls. refine: members that raise it leave at the end."""

    def conductance(s: Shell, total: float) -> float:
        vol = 2 * s.inner + s.cut
        return s.cut / max(min(vol, total - vol), 1e-300) if 0 < vol < total else 1.0

    def kernel(c: Csr, seed: int) -> set[int]:
        s, total = Shell(c, {seed}), float(c.w[c.row != c.nbr].sum())
        now = conductance(s, total)
        while s.near:
            def score(v: int) -> float:
                near = {x for x, _ in s.around(v)}
                closed = sum(len(near & {x for x, _ in s.around(u)}) / (len(near | {x for x, _ in s.around(u)}) if jaccard else 1) for u in near & s.own)
                return (closed + len(near & s.own)) / max(len(near), 1)

            order = sorted(s.near, key=lambda v: (-score(v), v))
            for v in order:
                s.add(v)
                q = conductance(s, total)
                if q < now - 1e-12:
                    now = q
                    break
                s.remove(v)
            else:
                break
        while refine:
            for u in sorted(s.own - {seed}):
                s.remove(u)
                q = conductance(s, total)
                if q < now - 1e-12:
                    now = q
                    break
                s.add(u)
            else:
                break
        return s.own

    return kernel


def two_phases() -> Kernel:
    """L = inner degree per member over border degree per border member: in the first phase members come, in the second those stay that keep L up; the seed must."""

    def value(s: Shell) -> float:
        inner, border = 2 * s.inner / max(len(s.own), 1), s.border()
        return inner / (s.cut / border) if border and s.cut > 1e-12 else np.inf if s.cut <= 1e-12 else 0.0

    def kernel(c: Csr, seed: int) -> set[int]:
        s = Shell(c, {seed})
        now = value(s)
        while s.near:
            best = None
            for v in sorted(s.near):
                q = value(Shell(c, s.own | {v}))
                if q > now + 1e-12 and (best is None or q > best[0] + 1e-12):
                    best = (q, v)
            if best is None:
                break
            now = best[0]
            s.add(best[1])
        for u in sorted(s.own - {seed}):
            t = Shell(c, s.own - {u})
            if value(t) > value(s) + 1e-12:
                s = t
        return s.own

    return kernel


def clique_around() -> Kernel:
    """The clique with the seed of the largest inner weight, then size."""
    from graphloom.kernels.order import cliques_from

    def kernel(c: Csr, seed: int) -> set[int]:
        rank = np.ones(c.n)
        rank[seed] = 0  # the seed comes before all others
        weight = lambda q: sum(w for u in q for v, w in zip(c.out(u).tolist(), c.weights(u).tolist(), strict=True) if v in q and v != u)
        best = max((set(q) for q in cliques_from(c, rank, seed)), key=lambda q: (weight(q), len(q)), default={seed})
        return best

    return kernel


def combined(first: Kernel, second: Callable[[Csr, set[int]], set[int]] | None = None, then: Kernel | None = None) -> Kernel:
    """The second detector goes on from what the first found: a function of sets, or a kernel run from each member, the union of both."""

    def kernel(c: Csr, seed: int) -> set[int]:
        own = first(c, seed)
        if second is not None:
            return second(c, own)
        return own.union(*(then(c, u) for u in sorted(own))) if then else own

    return kernel


def expanded(alpha: float = 1.0) -> Callable[[Csr, set[int]], set[int]]:
    """fitness from a set on, whose members stay."""

    def run(c: Csr, own: set[int]) -> set[int]:
        s = Shell(c, own)
        f = lambda i, k: 2 * i / max(2 * i + k, 1e-300) ** alpha
        while s.near:
            q, v = max(((f(s.inner + a, s.cut + b - a), -v) for v in s.near for a, b in [s.split(v)]), default=(0, 0))
            if q <= f(s.inner, s.cut) + 1e-12:
                break
            s.add(-v)
        return s.own

    return run


def breadth_first_set(size: int) -> Kernel:
    """A baseline: the first nodes by hops, then id."""

    def kernel(c: Csr, seed: int) -> set[int]:
        d = c.bfs([seed])
        order = np.lexsort((np.arange(c.n), np.where(d < 0, c.n, d)))
        return set(order[: min(size, int((d >= 0).sum()))].tolist())

    return kernel


def _push(c: Csr, seeds: list[int], alpha: float, epsilon: float) -> np.ndarray:
    p, r = np.zeros(c.n), np.zeros(c.n)
    r[seeds] = 1.0 / len(seeds)
    loops = np.bincount(c.row[c.row == c.nbr], c.w[c.row == c.nbr], c.n)
    vol = c.strength() + loops
    active = [u for u in seeds if vol[u]]
    while active:
        u = active.pop()
        if r[u] < epsilon * vol[u]:
            continue
        x = r[u]
        p[u] += alpha * x
        r[u] = (1 - alpha) * x / 2
        at = slice(c.ptr[u], c.ptr[u + 1])
        np.add.at(r, c.nbr[at], (1 - alpha) * x * c.w[at] / (2 * vol[u]))
        r[u] += (1 - alpha) * x * loops[u] / (2 * vol[u])  # a loop leads back with both its ends
        active += [v for v in {*c.nbr[at].tolist(), u} if r[v] >= epsilon * vol[v]]
    return p


def approximate_pagerank(g: Graph, seeds: DataFrame, alpha: float = 0.1, epsilon: float = 1e-6) -> DataFrame:
    """(seed, node, score): pushed mass of each seed by itself, as long as a node's residue is at least epsilon times its volume."""
    return per_source(g, seeds, lambda c, u: [(int(c.ids[u]), int(c.ids[v]), float(x)) for v, x in enumerate(_push(c, [u], alpha, epsilon)) if x > 0], "seed long, node long, score double")


def nibble(alpha: float = 0.1, epsilon: float = 1e-6) -> Kernel:
    """The prefix of least conductance of nodes sorted by pushed mass over volume."""

    def kernel(c: Csr, seed: int) -> set[int]:
        p = _push(c, [seed], alpha, epsilon)
        loops = np.bincount(c.row[c.row == c.nbr], c.w[c.row == c.nbr], c.n)
        vol, total = c.strength() + loops, float((c.strength() + loops).sum())
        order = sorted(np.flatnonzero(p).tolist(), key=lambda v: (-p[v] / max(vol[v], 1e-300), v))
        own, cut, v_in, best, keep = set(), 0.0, 0.0, np.inf, 1
        for i, u in enumerate(order[: c.n - 1], 1):
            for v, w in zip(c.out(u).tolist(), c.weights(u).tolist(), strict=True):
                if v != u:
                    cut += -w if v in own else w
            own.add(u)
            v_in += vol[u]
            q = cut / min(v_in, total - v_in) if 0 < v_in < total else np.inf
            if q < best - 1e-15:
                best, keep = q, i
        return set(order[:keep]) or {seed}

    return kernel


def set_conductance(g: Graph, nodes: DataFrame) -> DataFrame:
    """One row: cut over the lesser volume of nodes(id) and the rest; 1 where a volume is 0. Loops count twice."""
    mark = nodes.select("id", F.lit(1).alias("x")).distinct()
    e = g.edges.join(mark.select(F.col("id").alias("src"), F.col("x").alias("a")), "src", "left").join(mark.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst", "left").fillna(0, ["a", "b"])
    s = e.agg(F.sum(F.when(F.col("a") != F.col("b"), F.col("weight")).otherwise(0.0)).alias("cut"), F.sum(F.col("weight") * (F.col("a") + F.col("b"))).alias("v"), F.sum(2 * F.col("weight")).alias("t"))
    small = F.least(F.col("v"), F.col("t") - F.col("v"))
    return s.select(F.when(small > 0, F.col("cut") / small).otherwise(1.0).alias("conductance"))


def compared_to_truth(found: DataFrame, truth: DataFrame, any_community: bool = False) -> DataFrame:
    """(seed, jaccard, precision, recall, f1): each the best over the true communities (node, community) of the seed, or over any."""
    size = found.groupBy("seed").agg(F.count("*").alias("x"))
    true = truth.groupBy("community").agg(F.count("*").alias("y"))
    o = found.join(truth, "node").groupBy("seed", "community").agg(F.count("*").alias("k"))
    if not any_community:
        o = o.join(truth.select(F.col("node").alias("seed"), "community"), ["seed", "community"], "left_semi")
    o = o.join(size, "seed").join(true, "community")
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    best = o.groupBy("seed").agg(F.max(k / (x + y - k)).alias("jaccard"), F.max(k / x).alias("precision"), F.max(k / y).alias("recall"), F.max(2 * k / (x + y)).alias("f1"))
    return size.select("seed").join(best, "seed", "left").fillna(0.0)


def overlapping_by_fitness(g: Graph, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """(node, community): communities of nodes that no earlier one covers, nodes taken at random, until all are covered. On the driver."""
    from graphloom.kernels.csr import collect, frame

    c, kernel = collect(g), fitness(alpha)
    covered, rows = np.zeros(c.n, dtype=bool), []
    for u in np.random.default_rng(seed).permutation(c.n).tolist():
        if not covered[u]:
            own = kernel(c, u)
            covered[list(own)] = True
            rows += [(c.ids[v], c.ids[u]) for v in sorted(own)]
    return frame(g, rows, "node long, community long")
