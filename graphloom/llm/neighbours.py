"""Nearest neighbours by cosine with additive quantisation.

Vectors are scaled to length 1 and encoded as sums of M full-dimensional codewords. Codebooks are
fitted to residuals on a bounded sample, level by level; encoding keeps the BEAM best partial sums,
so later levels correct earlier ones. A stored norm of each reconstruction turns looked-up inner
products into cosine estimates. Every row is indexed and stays where it is: queries come to the index
in rounds, as a broadcast of at most QUERY_BYTES, so neither rows nor queries are shuffled. A task
keeps the k best of its rows for each query; of a block of rows, those whose estimate is within a
margin of the block's k-th best estimate and of the k-th best score so far are scored exactly, in
double precision, on the original vectors. The margin is MARGIN standard deviations of the
estimate's error, measured on sampled vectors that the codebooks were not fitted to.

Defined results: null, zero or non-finite vectors, and those of another length than the most
frequent, take no part; a null id neither; rows that repeat an id stand for themselves, but never
for the query of that id; queries that repeat an id with another vector are queries of their own,
those that repeat both are one; ties go to the smaller id; with no vectors there are no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import materialize

LEVELS, WORDS, BEAM = 16, 64, 8
#: Rows that the codebooks are fitted to, chosen by the hash of their id, and their bytes at most.
SAMPLE, SAMPLE_BYTES = 16384, 64 << 20
#: Bytes of query vectors in one round, and rows and queries that are compared at once.
QUERY_BYTES = 32 << 20
BLOCK, QUERIES = 8192, 64
MARGIN = 3.5


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


class Quantiser:
    """Codebooks of shape (levels, words, dim), and the spread of the estimate's error."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.flat = books.reshape(-1, books.shape[2])
        self.cross = (self.flat @ self.flat.T).reshape(*books.shape[:2], *books.shape[:2])  # inner products of all codewords
        self.error = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, levels: int = LEVELS, words: int = WORDS, seed: int = 5) -> Quantiser:
        apart = np.zeros(len(x), dtype=bool)
        apart[:: 8 if len(x) >= 64 else len(x) + 1] = len(x) >= 64
        own, others = x[~apart], x[apart] if apart.any() else x
        rng, rest, books = np.random.default_rng(seed), own.copy(), []
        for _ in range(levels):
            c = _kmeans(rest, words, rng)
            books.append(c)
            rest = rest - c[np.argmin((c * c).sum(1) - 2 * (rest @ c.T), axis=1)]
        out = cls(np.stack(books).astype(np.float32))
        codes, norms = out.encode(others)
        probe = own[:: max(1, len(own) // 256)]
        out.error = float((out.estimate(probe, codes, norms) - probe @ others.T).std())
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, levels) and norms of the sums, by beam search over |x - sum|²."""
        m, k = self.books.shape[:2]
        all_codes, all_norms = [], []
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            n = len(part)
            dot = (part @ self.flat.T).reshape(n, m, k)
            own = np.einsum("mkd,mkd->mk", self.books, self.books)
            cost, codes = np.zeros((n, 1), dtype=np.float32), np.zeros((n, 1, 0), dtype=np.int64)
            for j in range(m):
                step = (own[j] - 2 * dot[:, j])[:, None, :] + cost[:, :, None]
                for i in range(j):
                    step += 2 * self.cross[i, codes[:, :, i], j]
                b = min(beam, step.shape[1] * k)
                flat = step.reshape(n, -1)
                best = np.argpartition(flat, b - 1, axis=1)[:, :b]
                cost = np.take_along_axis(flat, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
            won = np.take_along_axis(codes, np.argmin(cost, axis=1)[:, None, None], axis=1)[:, 0]
            all_codes.append(won.astype(np.uint8))
            sums = sum(self.books[j][won[:, j]] for j in range(m))
            all_norms.append(np.sqrt((sums * sums).sum(1)))
        return np.concatenate(all_codes), np.concatenate(all_norms).astype(np.float32)

    def estimate(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Cosine estimates (queries, rows): looked-up inner products over stored norms."""
        m, k = self.books.shape[:2]
        table = (q @ self.flat.T).reshape(len(q), m, k)
        out = np.zeros((len(q), len(codes)), dtype=np.float32)
        for j in range(m):
            out += table[:, j][:, codes[:, j]]
        return out / np.maximum(norms, 1e-9)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(fine)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither large nor small components overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k rows of vectors with the largest cosine found for each query, itself excluded."""
    usable = _usable(vectors, id_col, vec_col)
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    usable = usable.where(F.size("v") == dim)
    asked = _usable(queries, id_col, vec_col).where(F.size("v") == dim).withColumn("key", F.xxhash64("v")).dropDuplicates(["id", "key"])
    asked = materialize(asked, "queries")
    rows = min(SAMPLE, max(SAMPLE_BYTES // (8 * dim), LEVELS * WORDS))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow().column(0).combine_chunks()
    model = Quantiser.fit(_unit(_matrix(sample)).astype(np.float32))
    ship = spark.sparkContext.broadcast((model.books, model.error))  # LEVELS * WORDS vectors, whatever the data
    rounds = max(1, -(-asked.count() * dim * 8 // QUERY_BYTES))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(ship.value[0])
        for b in batches:
            codes, norms = q.encode(_unit(_matrix(b.column(1))).astype(np.float32))
            binary = pa.array([x.tobytes() for x in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary, pa.array(norms)], names=["id", "v", "codes", "norm"])

    encoded = materialize(usable.mapInArrow(index, "id long, v array<double>, codes binary, norm float"), "codes")
    parts = []
    for r in range(rounds):
        batch = asked.where(F.pmod(F.xxhash64("id", "key", F.lit(7)), F.lit(rounds)) == r).select("id", "key", "v").toArrow().combine_chunks()
        if not batch.num_rows:
            continue
        want = spark.sparkContext.broadcast((np.asarray(batch.column(0)), np.asarray(batch.column(1)), _unit(_matrix(batch.column(2).combine_chunks()))))

        def search(batches: Iterator[pa.RecordBatch], want=want) -> Iterator[pa.RecordBatch]:
            q, (qids, keys, qv) = Quantiser(ship.value[0]), want.value
            near, margin = qv.astype(np.float32), MARGIN * ship.value[1]
            score, found = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), dtype=np.int64)
            for b in batches:
                for start in range(0, b.num_rows, BLOCK):
                    part = b.slice(start, BLOCK)
                    ids, v, norms = np.asarray(part.column(0)), _unit(_matrix(part.column(1))), np.asarray(part.column(3))
                    codes = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                    for lo in range(0, len(qids), QUERIES):
                        est = q.estimate(near[lo : lo + QUERIES], codes, norms)
                        est[qids[lo : lo + QUERIES, None] == ids[None, :]] = -2
                        kth = np.partition(est, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                        least = np.maximum(np.maximum(kth, score[lo : lo + QUERIES, -1]) - margin, -1.5)
                        for j in np.flatnonzero((est >= least[:, None]).any(axis=1)):
                            cand = np.flatnonzero(est[j] >= least[j])
                            s = np.concatenate([score[lo + j], np.minimum(v[cand] @ qv[lo + j], 1.0)])
                            i = np.concatenate([found[lo + j], ids[cand]])
                            top = np.lexsort((i, -s))[:k]
                            score[lo + j], found[lo + j] = s[top], i[top]
            at, rank = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qids[at], keys[at], found[at, rank], score[at, rank])], names=["query_id", "key", id_col, "score"])

        part = encoded.mapInArrow(search, f"query_id long, key long, {id_col} long, score double")
        parts.append(materialize(part, "found") if rounds > 1 else part)
    if not parts:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), id_col)
    found = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
