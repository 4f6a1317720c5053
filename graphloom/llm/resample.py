"""Importance resampling towards a target: hashed word-run features, log ratios of their frequencies, and a draw by Gumbel keys.

Texts longer than a bound are cut at word boundaries into chunks that are dealt over the tasks. A chunk carries the
n-1 words that follow it and owns the runs that start in it, so that chunks together hold each run once; counts and
weights of chunks are summed by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.numbering import numbered
from graphloom.plans.scratch import materialize

#: Bytes of a text that one task counts at a time; longer texts are cut.
CHUNK = 1 << 20
_WORD = re.compile(rb" *[^ ]+")
#: Bytes that part words become spaces: all of ASCII but digits and letters.
_PARTED = bytes(i if 48 <= i < 58 or 97 <= i < 123 or i >= 128 else 32 for i in range(256))


def spaced(text: bytes) -> bytes:
    """A-Z lower-cased and all but words made spaces, at the same offsets."""
    return text.lower().translate(_PARTED)


def cut(text: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, words carried) of a spaced text: chunks end at the first space after size bytes; a word is never cut."""
    at = 0
    while True:
        end = text.find(b" ", at + size)
        carried, stop = 0, end
        while end >= 0 and carried < n - 1:
            m = _WORD.match(text, stop)
            if not m:
                break
            carried, stop = carried + 1, m.end()
        if end < 0 or not _WORD.match(text, end):  # nothing follows
            yield text[at:], 0
            return
        yield text[at:stop], carried
        at = end


def runs(words: list[bytes], carried: int, n: int) -> list[int]:
    """CRC-32 of the runs of 1 to n words, joined by a space, that start at a word which is not carried."""
    own, now = len(words) - carried, list(map(crc32, words))
    out = now[:own]
    for k in range(1, n):
        now = list(map(crc32, words[k:], map(crc32, repeat(b" "), now)))
        out += now[:own]
    return out


def _pieces(docs: DataFrame, id_col: str, text_col: str, n: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(id, uid, carried, body) of texts that are one chunk, read in place, and of chunks of longer ones, written and dealt evenly."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    kind = dict(base.dtypes)["id"]
    short = base.where(F.octet_length("t") <= chunk).select("id", F.lit(None).cast("long").alias("uid"), F.lit(0).alias("carried"), F.col("t").cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for k, (body, carried) in enumerate(cut(spaced(b.column(2)[i].as_py()), n, chunk)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([k], pa.int32()), pa.array([carried], pa.int32()), pa.array([body], pa.binary())], names=["id", "uid", "part", "carried", "body"])

    long_ = base.where(F.octet_length("t") > chunk).select("id", F.monotonically_increasing_id().alias("uid"), F.col("t").cast("binary"))
    cuts = long_.mapInArrow(run, f"id {kind}, uid long, part int, carried int, body binary").repartition("uid", "part")
    return short, materialize(cuts.select("id", "uid", "carried", "body"), "chunks")


def _each(b: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Words that a piece owns and its features."""
    for carried, body in zip(b.column("carried").to_pylist(), b.column("body"), strict=True):
        words = spaced(body.as_py()).split()
        f = runs(words, carried, n)
        yield len(words) - carried, np.fromiter(f, dtype=np.int64, count=len(f))


def bucket_counts(docs: DataFrame, n: int = 2, buckets: int = 10000, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; one row of partial sums per task and bucket is shuffled."""
    return _counted(_pieces(docs, id_col, text_col, n, chunk), n, buckets)


def _counted(pieces: tuple[DataFrame, DataFrame], n: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, f in _each(b, n):
                np.add.at(total, f % buckets, 1) if len(f) < buckets // 8 else np.add(total, np.bincount(f % buckets, minlength=buckets), out=total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = [p.select("carried", "body").mapInArrow(run, "bucket long, n long") for p in pieces]
    return parts[0].union(parts[1]).groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): thousandths of the log ratio of target to source, each count one more, rounded down; a row for every bucket."""
    sums = [x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("all")).first()["all"] for x in (source, target)]
    spark = source.sparkSession
    table = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    one = lambda c: F.col(c).cast("double") + 1
    ratio = one("t") * F.lit(sums[0] + buckets) / (one("s") * F.lit(sums[1] + buckets))
    return table.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _floor_div(a: str, b: str) -> str:
    return f"({a} - pmod({a}, {b})) div {b}"


def weights(docs: DataFrame, gains: np.ndarray, n: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_words, n_features, weight), a row per row of docs: the mean gain of its features, rounded down; 0 without features."""
    return _weighed(_pieces(docs, id_col, text_col, n, chunk), gains, n)


def _weighed(pieces: tuple[DataFrame, DataFrame], gains: np.ndarray, n: int) -> DataFrame:
    ship = pieces[0].sparkSession.sparkContext.broadcast(gains)
    kind = dict(pieces[0].dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = ship.value
        for b in batches:
            got = [(w, len(f), int(g[f % len(g)].sum())) for w, f in _each(b, n)]
            cols = [pa.array([x[k] for x in got], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("uid"), *cols], names=["id", "uid", "w", "f", "g"])

    short, long_ = (p.mapInArrow(run, f"id {kind}, uid long, w long, f long, g long") for p in pieces)
    whole = long_.groupBy("uid").agg(F.first("id").alias("id"), F.sum("w").alias("w"), F.sum("f").alias("f"), F.sum("g").alias("g"))
    both = short.select("id", "w", "f", "g").union(whole.select("id", "w", "f", "g"))
    return both.select("id", F.col("w").alias("n_words"), F.col("f").alias("n_features"), F.when(F.col("f") > 0, F.expr(_floor_div("g", "f"))).otherwise(F.lit(0)).cast("long").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, n: int = 2, buckets: int = 10000, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row per row of docs.

    Features are all runs of 1 to n words, hashed into buckets; what is learnt is one number per bucket, so
    the driver and the broadcast hold `buckets` numbers whatever the input. score is the weight plus a Gumbel
    variate drawn from a hash of the id; the highest `percent` of the documents with at least least_words
    words get ranks from 1, ties by the lesser id; other ranks are null.

    A null text has no words: no features, weight 0, never drawn. A null id draws like an empty one and comes
    last among ties; rows that repeat an id are scored and drawn one by one, with the same variate. A text
    above `chunk` bytes is cut and its chunks are dealt over the tasks; its worker holds it whole only while
    it is cut. An empty target, or no documents, leave weights that only tell rare from common words. Other
    columns are not looked at.
    """
    pieces = _pieces(docs, id_col, text_col, n, chunk)
    s, t = materialize(_counted(pieces, n, buckets), "source-buckets"), materialize(bucket_counts(target, n, buckets, target.columns[0], text_col, chunk), "target-buckets")
    table = log_ratios(s, t, buckets).toArrow()  # as many rows as buckets
    gains = np.zeros(buckets, dtype=np.int64)
    gains[np.asarray(table.column("bucket"))] = np.asarray(table.column("gain"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(_weighed(pieces, gains, n).withColumn("score", (F.col("weight") + gumbel).cast("long")), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = numbered(fit, F.col("score").desc(), F.col("id").asc_nulls_last(), name="rank", first=1).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    cols = [F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score"]
    return ranked.select(*cols, "rank").union(scored.where(F.col("n_words") < least_words).select(*cols, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn; of a repeated id, all or none."""
    return docs.join(ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
