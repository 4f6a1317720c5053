"""Semiring algebra on matrices (i, j, v) and vectors (i, v); absent entries are the semiring's zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (add as an aggregate, add of two, multiply)
SEMIRINGS: dict[str, tuple[Callable, Callable, Callable]] = {
    "arithmetic": (F.sum, lambda a, b: a + b, lambda a, b: a * b),
    "min_plus": (F.min, F.least, lambda a, b: a + b),
    "max_plus": (F.max, F.greatest, lambda a, b: a + b),
    "min_max": (F.min, F.least, F.greatest),
    "max_min": (F.max, F.greatest, F.least),
    "logical": (lambda x: F.max((F.col(x) if isinstance(x, str) else x).cast("long")), lambda a, b: F.greatest(a.cast("long"), b.cast("long")), lambda a, b: ((a != 0) & (b != 0)).cast("long")),
    "galois": (lambda x: F.bit_xor((F.col(x) if isinstance(x, str) else x).cast("long")), lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")), lambda a, b: a.cast("long").bitwiseAND(b.cast("long"))),
}


def mxm(a: DataFrame, b: DataFrame, semiring: str = "arithmetic", onto: DataFrame | None = None) -> DataFrame:
    """a b, added to what onto holds if it is given."""
    add, _, mul = SEMIRINGS[semiring]
    joined = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    out = joined.groupBy("i", "j").agg(add(mul(F.col("x"), F.col("y"))).alias("v"))
    return out if onto is None else ewise_add(onto, out, semiring)


def mxv(a: DataFrame, x: DataFrame, semiring: str = "arithmetic", onto: DataFrame | None = None) -> DataFrame:
    """a x, added to what onto holds if it is given."""
    add, _, mul = SEMIRINGS[semiring]
    joined = a.withColumnRenamed("v", "m").join(x.select(F.col("i").alias("j"), F.col("v").alias("y")), "j")
    out = joined.groupBy("i").agg(add(mul(F.col("m"), F.col("y"))).alias("v"))
    if onto is None:
        return out
    pad = lambda t: t.select("i", F.lit(0).alias("j"), "v")
    return ewise_add(pad(onto), pad(out), semiring).select("i", "v")


def ewise_add(a: DataFrame, b: DataFrame, semiring: str = "arithmetic") -> DataFrame:
    add = SEMIRINGS[semiring][1]
    x, y = F.col("v"), F.col("w")
    both = a.join(b.withColumnRenamed("v", "w"), ["i", "j"], "full")
    v: Column = F.when(x.isNull(), y).when(y.isNull(), x).otherwise(add(x, y))
    return both.select("i", "j", v.alias("v"))


def ewise_mult(a: DataFrame, b: DataFrame, semiring: str = "arithmetic") -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", SEMIRINGS[semiring][2](F.col("v"), F.col("w")).alias("v"))


def row_reduce(a: DataFrame, semiring: str = "arithmetic") -> DataFrame:
    return a.groupBy("i").agg(SEMIRINGS[semiring][0]("v").alias("v"))


def column_reduce(a: DataFrame, semiring: str = "arithmetic") -> DataFrame:
    return a.groupBy(F.col("j").alias("i")).agg(SEMIRINGS[semiring][0]("v").alias("v"))


# matrices of graphs, and what they are


def adjacency_matrix(g) -> DataFrame:
    return g.arcs().groupBy(F.col("u").alias("i"), F.col("v").alias("j")).agg(F.sum("w").alias("v"))


def laplacian_matrix(g) -> DataFrame:
    """Degrees less adjacency, loops left out."""
    a = g.arcs().where("u <> v")
    diagonal = a.groupBy(F.col("u").alias("i")).agg(F.sum("w").alias("v")).select("i", F.col("i").alias("j"), "v")
    return diagonal.union(a.groupBy(F.col("u").alias("i"), F.col("v").alias("j")).agg((-F.sum("w")).alias("v")))


def incidence_matrix(g) -> DataFrame:
    """(node, edge number, value): 1 at the first end and -1 at the second (loops 0), edges numbered by (src, dst)."""
    from graphloom.operators.toolbox import indexed_edges

    e = indexed_edges(g).where("src <> dst")
    return e.select(F.col("src").alias("i"), F.col("eid").alias("j"), F.lit(1.0).alias("v")).union(e.select("dst", "eid", F.lit(-1.0)))


def pagerank_matrix(g, damping: float = 0.85) -> DataFrame:
    """Damped transition probabilities (j to i); the constant part (1 - damping) / n is left out."""
    a = adjacency_matrix(g)
    total = a.groupBy("i").agg(F.sum("v").alias("t"))
    return a.join(total, "i").select(F.col("j").alias("i"), F.col("i").alias("j"), (damping * F.col("v") / F.col("t")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def applied(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """f of every entry that is there."""
    return a.withColumn("v", f(F.col("v")))


def extracted(a: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The part of a at rows(i, n) and columns(j, m), renumbered."""
    return a.join(rows, "i").join(columns, "j").select(F.col("n").alias("i"), F.col("m").alias("j"), "v")


def assigned(a: DataFrame, part: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """a with the block of rows(i, n) and columns(j, m) replaced by part, whose entries are numbered n, m."""
    block = part.select(F.col("i").alias("n"), F.col("j").alias("m"), "v").join(rows, "n").join(columns, "m").select("i", "j", "v")
    hit = a.join(rows.select("i").distinct().withColumn("_r", F.lit(1)), "i", "left").join(columns.select("j").distinct().withColumn("_c", F.lit(1)), "j", "left")
    return hit.where("_r IS NULL OR _c IS NULL").select("i", "j", "v").union(block)


def _report(a: DataFrame) -> DataFrame:
    """One row: symmetric, sdd (symmetric, diagonals at least the other entries of their row together), laplacian (also rows that add up to 0, no positive entry off the diagonal)."""
    t = transposed(a).withColumnRenamed("v", "w")
    odd = a.join(t, ["i", "j"], "full").agg(F.count_if(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))) > 1e-12).alias("odd"))
    on = F.col("i") == F.col("j")
    rows = a.groupBy("i").agg(F.sum(F.when(on, F.col("v")).otherwise(0.0)).alias("d"), F.sum(F.when(on, 0.0).otherwise(F.abs("v"))).alias("o"), F.sum("v").alias("s"), F.coalesce(F.max(F.when(~on, F.col("v"))), F.lit(0.0)).alias("top"))
    r = rows.agg(F.count_if(F.col("d") < F.col("o") - 1e-9).alias("weak"), F.count_if((F.abs("s") > 1e-9) | (F.col("top") > 0)).alias("rest"))
    one = F.lit(1).alias("_k")
    b = odd.select("*", one).join(r.select("*", one), "_k")
    sym, sdd = F.col("odd") == 0, (F.col("odd") == 0) & (F.col("weak") == 0)
    return b.select(sym.alias("symmetric"), sdd.alias("sdd"), (sdd & (F.col("rest") == 0)).alias("laplacian"))


matrix_report = _report


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the inner product of two vectors."""
    return x.join(y.withColumnRenamed("v", "w"), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))


def outer(x: DataFrame, y: DataFrame) -> DataFrame:
    """All products of entries of two vectors: as large as the result must be."""
    one = F.lit(1).alias("_k")
    return x.select("i", "v", one).join(y.select(F.col("i").alias("j"), F.col("v").alias("w"), one), "_k").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


# algorithms as products


def algebraic_bfs(g, source: int) -> DataFrame:
    """(node, distance): min-plus products of unit arcs with a vector until it stays."""
    from graphloom.operators.toolbox import unweighted

    return algebraic_bellman_ford(unweighted(g), source)


def algebraic_bellman_ford(g, source: int) -> DataFrame:
    """(node, distance) by min-plus products; a negative cycle that the source reaches is an error."""
    from graphloom.plans.scratch import discard, materialize

    a = materialize(transposed(g.arcs().groupBy(F.col("u").alias("i"), F.col("v").alias("j")).agg(F.min("w").alias("v"))), "mx")
    x = materialize(g.vertices.where(F.col("id") == source).select(F.col("id").alias("i"), F.lit(0.0).alias("v")), "vx")
    for _ in range(g.vertices.count() + 1):
        new = materialize(mxv(a, x, "min_plus", onto=x), "vx")
        same = new.join(x.withColumnRenamed("v", "w"), "i", "left").where("w IS NULL OR v < w").isEmpty()
        discard(x)
        x = new
        if same:
            return x.select(F.col("i").alias("node"), F.col("v").alias("distance"))
    raise ValueError("the source reaches a negative cycle")


def algebraic_pagerank(g, damping: float = 0.85, tol: float = 1e-8, iterations: int = 100) -> DataFrame:
    """(node, score) by products with the PageRank matrix, scaled to sum 1."""
    from graphloom.plans.scratch import discard, materialize

    n, m = g.vertices.count(), materialize(pagerank_matrix(g, damping), "mx")
    base = g.vertices.select(F.col("id").alias("i"), F.lit((1 - damping) / max(n, 1)).alias("v"))
    x = materialize(base.withColumn("v", F.lit(1.0 / max(n, 1))), "vx")
    for _ in range(iterations):
        new = materialize(mxv(m, x, onto=base), "vx")
        delta = new.join(x.withColumnRenamed("v", "w"), "i").agg(F.sqrt(F.sum((F.col("v") - F.col("w")) ** 2))).first()[0] or 0.0
        discard(x)
        x = new
        if delta <= tol:
            break
    total = x.agg(F.sum("v")).first()[0] or 1.0
    return x.select(F.col("i").alias("node"), (F.col("v") / total).alias("score"))


def algebraic_triangles(g) -> DataFrame:
    """(node, triangles): half the row sums of (A A) x A."""
    a = g.arcs().where("u <> v").select(F.col("u").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("v")).distinct()
    t = row_reduce(ewise_mult(mxm(a, a), a)).select(F.col("i").alias("node"), (F.col("v") / 2).cast("long").alias("t"))
    return g.vertices.select(F.col("id").alias("node")).join(t, "node", "left").select("node", F.coalesce("t", F.lit(0)).alias("triangles"))


def algebraic_coarsening(g, matching: DataFrame, loops: bool = True):
    """P'AP with P the matrix of matched pairs (u, mate), as a graph."""
    from graphloom.graph import Graph

    to = matching.select(F.greatest("u", "mate").alias("i"), F.least("u", "mate").alias("j")).where("i <> j").distinct()
    p = g.vertices.select(F.col("id").alias("i")).join(to, "i", "left").select("i", F.coalesce("j", "i").alias("j"), F.lit(1.0).alias("v"))
    half = g.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))  # each edge once
    c = mxm(mxm(transposed(p), half), p)
    e = c.groupBy(F.greatest("i", "j").alias("src"), F.least("i", "j").alias("dst")).agg(F.sum("v").alias("weight"))
    return Graph(p.select(F.col("j").alias("id")).distinct(), e if loops else e.where("src <> dst"), g.directed)


# dense matrices, eigenvectors and solvers on graphs of checked size


def eigenvectors(g, k: int = 1, matrix: str = "laplacian", largest: bool = False) -> DataFrame:
    """(rank, value, node, v): k eigenpairs of the laplacian or adjacency matrix of an undirected graph, the least (largest) values first; dense."""
    import numpy as np

    from graphloom.kernels import spectral
    from graphloom.kernels.csr import frame

    a, c = (spectral.laplacian if matrix == "laplacian" else spectral.adjacency)(g)
    val, vec = np.linalg.eigh(a)
    order = (np.argsort(-val) if largest else np.argsort(val))[:k]
    rows = [(r, float(val[i]), c.ids[j], float(vec[j, i])) for r, i in enumerate(order) for j in range(c.n)]
    return frame(g, rows, "rank int, value double, node long, v double")


def spectral_colouring(g) -> DataFrame:
    """(node, colour): nodes in order of the last Laplacian eigenvector take the least colour that no coloured neighbour has; dense."""
    import numpy as np

    from graphloom.kernels.csr import frame
    from graphloom.kernels.spectral import laplacian

    lap, c = laplacian(g)
    colour = np.full(c.n, -1)
    for u in np.argsort(np.linalg.eigh(lap)[1][:, -1], kind="stable").tolist() if c.n else []:
        taken = set(colour[c.out(u)].tolist())
        colour[u] = next(i for i in range(c.n + 1) if i not in taken)
    return frame(g, list(zip(c.ids.tolist(), colour.tolist(), strict=True)), "node long, colour long")


def solved(g, b: DataFrame, method: str = "multilevel", tol: float = 1e-6) -> DataFrame:
    """(node, x) with L x = b (node, v), b adding up to 0 in each component: by cg, jacobi_cg, gauss_seidel (dense) or multilevel."""
    import numpy as np

    from graphloom.kernels import spectral
    from graphloom.kernels.csr import collect, frame

    c = collect(g)
    t = b.select("node", F.col("v").cast("double")).toArrow()
    rhs = np.zeros(c.n)
    rhs[np.searchsorted(c.ids, t.column(0).to_numpy())] = t.column(1).to_numpy()
    if method == "gauss_seidel":
        x = spectral.gauss_seidel(spectral.laplacian(g)[0], rhs, tol=tol, rounds=100_000)
    elif method == "multilevel":
        x = spectral.multilevel(c, rhs, tol)
    else:
        rows = spectral.Rows(c)
        x = spectral.conjugate_gradient(rows, rhs, tol, rows.diagonal if method == "jacobi_cg" else None)
    x = x - x.mean()
    return frame(g, list(zip(c.ids.tolist(), x.tolist(), strict=True)), "node long, x double")


def pivot_layout(g, dim: int = 2, pivots: int = 50) -> DataFrame:
    """(node, x): coordinates from hop distances to pivots, each the node farthest from those before, by the singular vectors of the centred squares."""
    import numpy as np

    from graphloom.kernels.csr import collect, frame

    c = collect(g)
    rows, near, u = [], np.full(c.n, np.iinfo(np.int64).max), 0
    for _ in range(min(pivots, c.n)):
        d = c.bfs([u])
        d = np.where(d < 0, c.n, d)
        rows.append(d)
        near = np.minimum(near, d)
        u = int(np.argmax(near))
    s = np.array(rows, dtype=float).reshape(-1, c.n).T ** 2
    s = -0.5 * (s - s.mean(axis=0) - s.mean(axis=1, keepdims=True) + s.mean()) if c.n else s
    val, vec = np.linalg.eigh(s.T @ s) if c.n else (np.zeros(0), np.zeros((0, 0)))
    x = s @ vec[:, ::-1][:, :dim] if c.n else s
    return frame(g, [(i, [float(y) for y in p]) for i, p in zip(c.ids.tolist(), x, strict=True)], "node long, x array<double>")
