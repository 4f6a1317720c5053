"""Vectorised word and gram hashing shared by the text operators; runs inside Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from xxhash import xxh64_intdigest

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)


#: Rows of an Arrow batch of texts at most, so that a worker holds a few megabytes of them.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches for operators that read whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: What operators keep in a worker from one task to the next.
_kept: list[dict] = []


def keep(cache: dict) -> dict:
    """From now on forget, with which tasks of fresh start, empties cache."""
    _kept.append(cache)
    return cache


def forget() -> None:
    """Empty all that is kept in this process, and give unused memory back to the system."""
    for cache in _kept:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def fresh(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, without what other operators kept in the worker: Spark hands a worker from stage to stage, with all its memory."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)

    return out


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like wanted that are not taken, whatever their case."""
    low, out = {c.lower() for c in taken}, []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 texts of a string column; null becomes empty."""
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def split_space(text: bytes) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ ; bytes.split cuts at exactly those six bytes."""
    return text.split()


def split_lower(text: bytes) -> list[bytes]:
    """The same words after A-Z became lower case; bytes.lower touches ASCII only."""
    return text.lower().split()


def chunks(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes together; a longer document is a range of its own."""
    a = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), dtype=U, count=len(words))


class Grams:
    """Hashes of word runs within one concatenation of documents, by prefix sums of a polynomial in 64-bit arithmetic."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        with np.errstate(over="ignore"):
            up = np.full(n + 1, U(_BASE))
            up[0] = U(1)
            np.multiply.accumulate(up, out=up)
            self.down = np.full(n + 1, U(_INV))
            self.down[0] = U(1)
            np.multiply.accumulate(self.down, out=self.down)
            self.sums = np.zeros(n + 1, dtype=U)
            np.cumsum(h * up[:n], out=self.sums[1:])
        self.n = n

    def all(self, k: int) -> np.ndarray:
        """The hash of words i to i+k-1 for every i where the run fits in the array."""
        if self.n < k:
            return np.zeros(0, dtype=U)
        with np.errstate(over="ignore"):
            return fmix((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1] + U(k))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of words start to end-1 of each span."""
        with np.errstate(over="ignore"):
            return fmix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def runs_within(lens: np.ndarray, k: int) -> np.ndarray:
    """True where words i to i+k-1 of the concatenation lie in one document."""
    n = int(lens.sum())
    if n < k:
        return np.zeros(0, dtype=bool)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(n)  # words from i to its document's end
    return left[: n - k + 1] >= k


def i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
