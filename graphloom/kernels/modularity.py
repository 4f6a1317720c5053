"""Louvain and Leiden: rounds in which a random half of the nodes moves at once, by arrays that hold a row per node; edges may lie elsewhere."""

from __future__ import annotations

import numpy as np

ROUNDS, LEVELS = 40, 20


def totals(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Volume of each node, loops counting twice, and the total weight, of edges listed once."""
    return np.bincount(u, w, n) + np.bincount(v, w, n), float(w.sum())


def modularity(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, gamma: float = 1.0) -> float:
    k, total = totals(u, v, w, len(c))
    vol = np.bincount(c, k)
    return float(w[c[u] == c[v]].sum() / total - gamma * (vol * vol).sum() / (4 * total * total)) if total else 0.0


def offers(a: np.ndarray, b: np.ndarray, x: np.ndarray, c: np.ndarray, k: np.ndarray, vol: np.ndarray, total: float, gamma: float, may: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool, float]:
    """Of all arcs a -> b of some nodes, which lie together: (nodes that may move and gain by it, the communities that gain most, whether any node gains, weight from the nodes to their own communities).

    within: nodes stay inside these groups, and only nodes that are alone move, to nodes that don't.
    """
    n = len(c)
    if within is not None:
        near = within[a] == within[b]
        a, b, x = a[near], b[near], x[near]
    if not len(a):
        return a, a, False, 0.0
    begins = np.append(True, a[1:] != a[:-1])
    rows, key = a[begins], (np.cumsum(begins) - 1) * n + c[b]
    order = np.argsort(key, kind="stable")
    ks = key[order]
    first = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
    aff = np.add.reduceat(x[order], first)
    row, to = ks[first] // n, ks[first] % n
    node, own = rows[row], np.zeros(len(rows))
    same = to == c[node]
    own[row[same]] = aff[same]
    gain = (aff - own[row]) / total + gamma * ((vol[c[node]] - k[node]) - vol[to]) * k[node] / (2 * total * total)
    good = ~same & (gain > 1e-12)
    if within is not None:
        alone = np.bincount(c, minlength=n)[c] == 1
        stays = np.zeros(n, dtype=bool)
        stays[c[~(may & alone)]] = True  # communities that keep a member
        good &= alone[node] & (stays[to] | ~may[node])
    node, to, gain = node[good], to[good], gain[good]
    order = np.lexsort((to, -gain, node))
    node, to = node[order], to[order]
    go = np.append(True, node[1:] != node[:-1])[: len(node)] & may[node]
    return node[go], to[go], bool(len(node)), float(own.sum())


class Level:
    """A graph of nodes 0 to n - 1 whose edges, listed once, are held as arrays."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int):
        self.u, self.v, self.w, self.n = u, v, w, n
        self.k, self.total = totals(u, v, w, n)
        keep = u != v
        self.loops = float(w[~keep].sum())
        a, b, x = np.concatenate([u[keep], v[keep]]), np.concatenate([v[keep], u[keep]]), np.concatenate([w[keep], w[keep]])
        order = np.argsort(a, kind="stable")
        self.arcs = a[order], b[order], x[order]

    def offers(self, c: np.ndarray, vol: np.ndarray, gamma: float, may: np.ndarray, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, bool, float]:
        return offers(*self.arcs, c, self.k, vol, self.total, gamma, may, within)

    def contracted(self, c: np.ndarray, n: int) -> Level:
        return Level(*contracted(self.u, self.v, self.w, c, n), n)


def moved(g: Level, c: np.ndarray, gamma: float, rng: np.random.Generator, within: np.ndarray | None = None) -> np.ndarray:
    """Communities after rounds of moves to the neighbour community of the largest gain; the best of all rounds by modularity.

    within: nodes stay inside these groups, and only nodes that are alone move, to nodes that don't: the
    communities made this way are connected.
    """
    c, best, best_c, quiet = c.copy(), -np.inf, c, 0
    most = ROUNDS if within is None else 12
    for turn in range(most + (within is None)):
        vol, before = np.bincount(c, g.k, g.n), rng.bit_generator.state
        may = rng.random(g.n) < 0.5
        node, to, some, inner = g.offers(c, vol, gamma, may, within)
        if within is None and turn:  # what the round before has brought
            q = (inner / 2 + g.loops) / g.total - gamma * float((vol * vol).sum()) / (4 * g.total * g.total)
            quiet = 0 if q > best + 1e-7 else quiet + 1
            if q > best:
                best, best_c = q, c.copy()
            if quiet >= 4 or turn == most:
                rng.bit_generator.state = before
                break
        if not some:
            break
        c[node] = to
    return best_c if within is None and best > -np.inf else c


def _compact(c: np.ndarray) -> tuple[np.ndarray, int]:
    names, c = np.unique(c, return_inverse=True)
    return c, len(names)


def contracted(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.maximum(c[u], c[v]), np.minimum(c[u], c[v])
    key, inv = np.unique(a * n + b, return_inverse=True)
    return key // n, key % n, np.bincount(inv, w, len(key))


def louvain(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, gamma: float = 1.0, seed: int = 1, start: np.ndarray | None = None, refine: bool = False, leiden: bool = False) -> np.ndarray:
    """Communities of nodes 0 to n - 1. leiden: levels contract the refined communities and go on from the moved ones."""
    return detected(Level(u, v, w, n), gamma, seed, start, refine, leiden)


def detected(g: Level, gamma: float = 1.0, seed: int = 1, start: np.ndarray | None = None, refine: bool = False, leiden: bool = False) -> np.ndarray:
    """Communities of a level, wherever its edges are held: the moves are the same."""
    rng, whole = np.random.default_rng(seed), g
    c = np.arange(g.n) if start is None else _compact(start)[0]
    at = np.arange(g.n)  # community of each original node's supernode
    for _ in range(LEVELS):
        if not g.total:
            break
        now = moved(g, c, gamma, rng)
        fine = moved(g, np.arange(g.n), gamma, rng, within=now) if leiden else now
        fine, m = _compact(fine)
        if m == g.n:
            c = now
            break
        coarse_c = np.zeros(m, dtype=np.int64)
        coarse_c[fine] = now
        g = g.contracted(fine, m)
        at, c = fine[at], _compact(coarse_c)[0] if leiden else np.arange(m)
    out = c[at]
    if refine and whole.total:
        out = moved(whole, _compact(out)[0], gamma, rng)
    return _compact(out)[0]


def map_equation(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> float:
    """Two-level description length of a random walk, in bits."""
    k, total = totals(u, v, w, len(c))
    cut = np.zeros(int(c.max()) + 1)
    far = c[u] != c[v]
    np.add.at(cut, c[u][far], w[far])
    np.add.at(cut, c[v][far], w[far])
    plogp = lambda p: float((p[p > 0] * np.log2(p[p > 0])).sum())
    q, p = cut / (2 * total), k / (2 * total)
    vol = np.bincount(c, p, len(q))
    return plogp(np.array([q.sum()])) - 2 * plogp(q) - plogp(p) + plogp(q + vol)


def louvain_map(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, rounds: int = 32, levels: int = LEVELS) -> np.ndarray:
    """Communities by single moves that shorten the map equation, level by level."""
    at, c0 = np.arange(n), None
    for _ in range(levels):
        k, total = totals(u, v, w, n)
        if not total:
            break
        c, p = np.arange(n), k / (2 * total)
        keep = u != v
        a, b, x = np.concatenate([u[keep], v[keep]]), np.concatenate([v[keep], u[keep]]), np.concatenate([w[keep], w[keep]]) / (2 * total)
        order = np.argsort(a, kind="stable")
        b, x, ptr = b[order], x[order], np.searchsorted(a[order], np.arange(n + 1))
        out = np.bincount(a, np.concatenate([w[keep], w[keep]]) / (2 * total), n)
        q, vol = out.copy(), p.copy()
        log = lambda z: z * np.log2(z) if z > 1e-15 else 0.0
        for _ in range(rounds):
            changes = 0
            for i in range(n):
                lo, hi = ptr[i], ptr[i + 1]
                if lo == hi:
                    continue
                near: dict[int, float] = {}
                for j, y in zip(c[b[lo:hi]].tolist(), x[lo:hi].tolist(), strict=True):
                    near[j] = near.get(j, 0.0) + y
                old, s = int(c[i]), float(q.sum())
                base, best, to = near.get(old, 0.0), -1e-12, old
                qo = q[old] - out[i] + 2 * base
                for d, y in near.items():
                    if d == old:
                        continue
                    qd = q[d] + out[i] - 2 * y
                    s2 = s - q[old] - q[d] + qo + qd
                    delta = log(s2) - log(s) - 2 * (log(qo) + log(qd) - log(q[old]) - log(q[d])) + log(qo + vol[old] - p[i]) + log(qd + vol[d] + p[i]) - log(q[old] + vol[old]) - log(q[d] + vol[d])
                    if delta < best:
                        best, to = delta, d
                if to != old:
                    q[to] += out[i] - 2 * near[to]
                    q[old] = max(qo, 0.0)
                    vol[old] -= p[i]
                    vol[to] += p[i]
                    c[i] = to
                    changes += 1
            if not changes:
                break
        c, m = _compact(c)
        at = c[at]
        if m == n:
            break
        u, v, w = contracted(u, v, w, c, m)
        n, c0 = m, c
    return _compact(at)[0]
