"""Depth-first search, biconnected parts, planarity and cliques on compressed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from graphloom.kernels.csr import Csr


def dfs(c: Csr, source: int) -> list[tuple[int, int]]:
    """(node, parent) in the order met from source, least neighbours first; the source's parent is -1."""
    seen, out, stack = np.zeros(c.n, dtype=bool), [], [(source, -1)]
    while stack:
        u, p = stack.pop()
        if not seen[u]:
            seen[u] = True
            out.append((u, p))
            stack += [(v, u) for v in c.out(u)[::-1].tolist() if not seen[v]]
    return out


def biconnected(c: Csr) -> list[list[tuple[int, int]]]:
    """Edges of each biconnected part, loops left out."""
    num, low = np.full(c.n, -1), np.zeros(c.n, dtype=np.int64)
    clock, parts, edges = 0, [], []
    for root in range(c.n):
        if num[root] >= 0:
            continue
        num[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, iter(zip(c.out(root).tolist(), c.edges_of(root).tolist(), strict=True)))]
        while stack:
            u, via, around = stack[-1]
            for v, e in around:
                if e == via or v == u:
                    continue
                if num[v] < 0:
                    num[v] = low[v] = clock
                    clock += 1
                    edges.append((u, v))
                    stack.append((v, e, iter(zip(c.out(v).tolist(), c.edges_of(v).tolist(), strict=True))))
                    break
                if num[v] < num[u]:
                    edges.append((u, v))
                    low[u] = min(low[u], num[v])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[u])
                    if low[u] >= num[p]:
                        part = []
                        while True:
                            part.append(edges.pop())
                            if part[-1] == (p, u):
                                break
                        parts.append(part)
    return parts


def _faces_fit(part: list[tuple[int, int]]) -> bool:
    """Whether a biconnected part can be drawn: bridges of what is drawn are put into faces that hold all their feet, the least free first."""
    near: dict[int, set[int]] = {}
    for a, b in part:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    n, m = len(near), sum(map(len, near.values())) // 2
    if n < 5 or m < 9:
        return True
    if m > 3 * n - 6:
        return False

    def path(start: int, goals: set[int], inside: set[int]) -> list[int]:
        """A shortest path from start over nodes inside to a goal."""
        came, queue = {start: start}, [start]
        for u in queue:
            for v in near[u]:
                if v in goals and v != start and (u != start or v in inside):
                    out = [v, u]
                    while out[-1] != start:
                        out.append(came[out[-1]])
                    return out[::-1]
                if v in inside and v not in came:
                    came[v] = u
                    queue.append(v)
        return []

    first = next(iter(near))
    second = next(iter(near[first]))
    near[first].discard(second)
    near[second].discard(first)
    cycle = path(second, {first}, set(near) - {first, second})
    near[first].add(second)
    near[second].add(first)
    drawn = set(cycle)
    done = {frozenset(x) for x in zip(cycle, cycle[1:] + cycle[:1], strict=True)}
    faces = [cycle, cycle[::-1]]
    while len(done) < m:
        bridges: list[tuple[set[int], set[int]]] = []  # (feet, inner nodes)
        free = set(near) - drawn
        while free:
            inner, queue = set(), [free.pop()]
            while queue:
                u = queue.pop()
                inner.add(u)
                more = near[u] & free
                free -= more
                queue += more
            bridges.append((set().union(*(near[u] for u in inner)) & drawn, inner))
        bridges += [({a, b}, set()) for a in drawn for b in near[a] if b in drawn and a < b and frozenset((a, b)) not in done]
        best = None
        for feet, inner in bridges:
            fit = [i for i, f in enumerate(faces) if feet <= set(f)]
            if not fit:
                return False
            if best is None or len(fit) < best[0]:
                best = (len(fit), feet, inner, fit[0])
            if best[0] == 1:
                break
        _, feet, inner, at = best
        a = next(iter(feet))
        if inner:
            line = path(a, feet - {a}, inner)
        else:
            line = [a, next(iter(feet - {a}))]
        face = faces.pop(at)
        i, j = face.index(line[0]), face.index(line[-1])
        one = face[i : j + 1] if i <= j else face[i:] + face[: j + 1]
        two = face[j : i + 1] if j <= i else face[j:] + face[: i + 1]
        faces += [one + line[-2:0:-1], two + line[1:-1]]
        drawn |= set(line)
        done |= {frozenset(x) for x in zip(line, line[1:], strict=False)}
    return True


def planar(c: Csr) -> bool:
    return all(_faces_fit(p) for p in biconnected(c))


def degeneracy(c: Csr) -> np.ndarray:
    """Nodes in the order in which one of the least degree is taken off, again and again."""
    deg = c.degree().copy()
    bins: list[set[int]] = [set() for _ in range(int(deg.max()) + 1 if c.n else 1)]
    for u, d in enumerate(deg.tolist()):
        bins[d].add(u)
    out, gone, d = [], np.zeros(c.n, dtype=bool), 0
    while len(out) < c.n:
        while not bins[d]:
            d += 1
        u = min(bins[d])
        bins[d].discard(u)
        gone[u] = True
        out.append(u)
        for v in c.out(u).tolist():
            if not gone[v] and v != u:
                bins[deg[v]].discard(v)
                deg[v] -= 1
                bins[deg[v]].add(v)
        d = max(d - 1, 0)
    return np.array(out, dtype=np.int64)


def cliques_from(c: Csr, rank: np.ndarray, u: int) -> Iterator[list[int]]:
    """Maximal cliques whose first node by rank is u."""
    around = {v for v in c.out(u).tolist() if v != u}
    near: dict[int, set[int]] = {}

    def of(v: int) -> set[int]:
        if v not in near:
            near[v] = {x for x in c.out(v).tolist() if x != v}
        return near[v]

    stack = [([u], {v for v in around if rank[v] > rank[u]}, {v for v in around if rank[v] < rank[u]})]
    while stack:
        own, may, out = stack.pop()
        if not may and not out:
            yield sorted(own)
            continue
        if not may:
            continue
        pivot = max(may | out, key=lambda v: len(of(v) & may))
        for v in sorted(may - of(pivot)):
            stack.append(([*own, v], may & of(v), out & of(v)))
            may = may - {v}
            out = out | {v}
