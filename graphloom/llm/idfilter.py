"""A Bloom filter of ids with a fixed bound, so that texts of rows that can't match are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as X

#: Bits at most (4 MB). Beyond some ten million ids it lets more and more rows pass, which costs time and nothing else.
MAX_BITS = 1 << 25
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(X.fmix(ids.view(X.U) + X.U(s)) % X.U(bits)).astype(np.int64) for s in _SALTS]


def bloom(ids: DataFrame, id_col: str = "id") -> np.ndarray:
    """64-bit words of the filter; at most MAX_BITS / 64 of them come to the driver."""
    n = ids.count()
    bits = 1 << 12
    while bits < min(16 * n, MAX_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, dtype=X.U)
        for b in batches:
            for p in _places(np.asarray(b.column(0)), bits):
                np.bitwise_or.at(words, p >> 6, X.U(1) << (p & 63).astype(X.U))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(X.i64(words[at]))], names=["at", "w"])

    rows = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long")).mapInArrow(X.fresh(run), "at long, w long").groupBy("at").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(bits // 64, dtype=X.U)
    out[np.asarray(rows.column("at"), dtype=np.int64)] = np.asarray(rows.column("w")).astype(np.int64).view(X.U)
    return out


def may_hold(words: np.ndarray, col: pa.Array) -> np.ndarray:
    """Which of these ids may be in the filter; null ids are not."""
    ids = np.asarray(col.fill_null(0).cast(pa.int64()))
    hit = ~np.asarray(col.is_null()).astype(bool)
    for p in _places(ids, len(words) * 64):
        hit &= (words[p >> 6] >> (p & 63).astype(X.U) & X.U(1)).astype(bool)
    return hit


def split_by(df: DataFrame, words: np.ndarray, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be in the filter, and those whose id is not; both keep df's columns."""
    X.small_batches(df.sparkSession)
    ship = df.sparkSession.sparkContext.broadcast(words)
    at = df.columns.index(id_col)

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(may_hold(ship.value, b.column(at)) == wanted))

        return df.mapInArrow(X.fresh(run), df.schema)

    return part(True), part(False)
