"""Dense spectral calculations and iterative solvers on a graph of checked size."""

from __future__ import annotations

import numpy as np

from graphloom.graph import Graph
from graphloom.kernels.csr import Csr, TooLarge, collect

#: Nodes of a dense matrix at most.
SPECTRAL = 6000


def adjacency(g: Graph) -> tuple[np.ndarray, Csr]:
    if g.vertices.count() > SPECTRAL:
        raise TooLarge(f"dense matrices are for {SPECTRAL} nodes at most")
    c = collect(g)
    a = np.zeros((c.n, c.n))
    np.add.at(a, (c.row, c.nbr), c.w)
    return a, c


def laplacian(g: Graph) -> tuple[np.ndarray, Csr]:
    a, c = adjacency(g)
    np.fill_diagonal(a, 0.0)
    return np.diag(a.sum(axis=1)) - a, c


def pseudo_inverse(lap: np.ndarray) -> np.ndarray:
    """Of a Laplacian, component by component through its eigenvectors."""
    val, vec = np.linalg.eigh(lap)
    keep = val > 1e-9 * max(val.max(), 1.0)
    return (vec[:, keep] / val[keep]) @ vec[:, keep].T


def inverse_in_place(a: np.ndarray, block: int = 256) -> None:
    """Of a positive definite matrix, by sweeps over blocks of its diagonal; beside it only two strips are held."""
    n = len(a)
    for k in range(0, n, block):
        here = slice(k, min(k + block, n))
        pivot = np.linalg.inv(a[here, here])
        row = pivot @ a[here]
        column = a[:, here].copy()
        for i in range(0, n, block):
            if i != k:
                rows = slice(i, min(i + block, n))
                a[rows] -= column[rows] @ row
                a[rows, here] = -column[rows] @ pivot
        row[:, here] = pivot
        a[here] = row


class Rows:
    """The Laplacian of a graph as a product, without its matrix."""

    def __init__(self, c: Csr):
        inner = c.row != c.nbr
        self.row, self.nbr, self.w, self.n = c.row[inner], c.nbr[inner], c.w[inner], c.n
        self.diagonal = np.bincount(self.row, self.w, self.n)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return self.diagonal * x - np.bincount(self.row, self.w * x[self.nbr], self.n)


def conjugate_gradient(a, b: np.ndarray, tol: float = 1e-5, diagonal: np.ndarray | None = None, rounds: int | None = None) -> np.ndarray:
    """x with a x = b for symmetric semi-definite a; a diagonal preconditions, none is the identity."""
    inv = np.ones(len(b)) if diagonal is None else np.where(diagonal > 0, 1 / np.maximum(diagonal, 1e-300), 1.0)
    x = np.zeros(len(b))
    r = b - a @ x
    z = inv * r
    p, rz, goal = z.copy(), float(r @ z), tol * max(np.linalg.norm(b), 1e-300)
    for _ in range(rounds or 10 * len(b)):
        if np.linalg.norm(r) <= goal:
            break
        ap = a @ p
        step = rz / float(p @ ap)
        x += step * p
        r -= step * ap
        z = inv * r
        new = float(r @ z)
        p = z + new / rz * p
        rz = new
    return x


def gauss_seidel(a: np.ndarray, b: np.ndarray, x: np.ndarray | None = None, tol: float = 1e-15, rounds: int = 1000) -> np.ndarray:
    """Relaxation of a x = b row by row until the residual is at most tol, or for so many rounds."""
    x = np.zeros(len(b)) if x is None else x.astype(float).copy()
    for _ in range(rounds):
        for i in range(len(b)):
            if a[i, i]:
                x[i] += (b[i] - a[i] @ x) / a[i, i]
        if np.linalg.norm(b - a @ x) <= tol:
            break
    return x


def multilevel(c: Csr, b: np.ndarray, tol: float = 1e-6, cycles: int = 100) -> np.ndarray:
    """x with L x = b (b adding up to 0 in each component): cycles of smoothing and a coarse correction over matched pairs, as preconditioner of conjugate gradients."""
    levels, rows = [], Rows(c)
    ids, row, nbr, w = c.n, rows.row, rows.nbr, rows.w
    while ids > 50 and len(row):
        mate = np.arange(ids)
        free = np.ones(ids, dtype=bool)
        for e in np.argsort(-w, kind="stable").tolist():
            a, d = int(row[e]), int(nbr[e])
            if free[a] and free[d]:
                free[a] = free[d] = False
                mate[max(a, d)] = min(a, d)
        names, to = np.unique(mate, return_inverse=True)
        if len(names) > 0.95 * ids:
            break
        levels.append((row, nbr, w, ids, to))
        a, d = to[row], to[nbr]
        keep = a != d
        key, inv = np.unique(a[keep] * len(names) + d[keep], return_inverse=True)
        row, nbr, w, ids = key // len(names), key % len(names), np.bincount(inv, w[keep], len(key)), len(names)
    dense = np.zeros((ids, ids))
    np.add.at(dense, (row, nbr), -w)
    dense -= np.diag(dense.sum(axis=1))
    coarse = pseudo_inverse(dense) if ids else dense

    def smooth(level: tuple, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        row, nbr, w, n, _ = level
        diag = np.maximum(np.bincount(row, w, n), 1e-300)
        return x + 0.6 * (r - (diag * x - np.bincount(row, w * x[nbr], n))) / diag

    def cycle(k: int, r: np.ndarray) -> np.ndarray:
        if k == len(levels):
            return coarse @ r
        level = levels[k]
        row, nbr, w, n, to = level
        x = smooth(level, smooth(level, np.zeros(n), r), r)
        rest = r - (np.bincount(row, w, n) * x - np.bincount(row, w * x[nbr], n))
        x = x + cycle(k + 1, np.bincount(to, rest))[to]
        return smooth(level, smooth(level, x, r), r)

    x = np.zeros(c.n)
    r = b - rows @ x
    z = cycle(0, r)
    p, rz = z.copy(), float(r @ z)
    for _ in range(cycles * 10):
        if np.linalg.norm(r) <= tol * max(np.linalg.norm(b), 1e-300):
            break
        ap = rows @ p
        step = rz / float(p @ ap)
        x, r = x + step * p, r - step * ap
        z = cycle(0, r)
        new = float(r @ z)
        p, rz = z + new / rz * p, new
    return x - x.mean()
