"""Benchmark decontamination by winnowing.

Both sides are hashed in k-grams of K words; of each W successive k-grams the least is kept, so any
shared run of K + W - 1 = SPAN words shares a kept fingerprint. Where the sets of fingerprints meet,
the hit is extended: every SPAN-word window around it is compared, word by word, with the item
windows of its hash. Items with fewer words than SPAN are one window each and are looked up by
windows of their own length in the same way.

Benchmarks are read in shards of at most SHARD_WORDS words, so what a task holds has a fixed bound;
each further shard is one more pass over the documents.

Defined results: null and empty texts have no words; items without words have no windows; a row is
judged by its own text, so repeated rows and null ids need no care; an item id counts once, and a
null item id not at all, though its words are hit; extra columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import textops as X
from graphloom.plans.scratch import materialize

SPAN, K = 8, 5
W = SPAN - K + 1
#: Words of benchmark items that a task holds at once.
SHARD_WORDS = 2_000_000
#: A-Z to a-z; every other byte that is not of a word to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    r"""Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became lower case."""
    return text.translate(_FOLD).split()


def fingerprints(g: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Positions of k-grams that are the least of some w successive ones of their document. ok: the w k-grams from here are of one document."""
    if len(g) < w or not ok.any():
        return np.zeros(0, dtype=np.int64)
    low = X.sliding_min(g, w)
    keep = np.zeros(len(g), dtype=bool)
    for j in range(w):
        keep[j : j + len(low)] |= (g[j : j + len(low)] == low) & ok[: len(low)]
    return np.flatnonzero(keep)


class Shard:
    """Some items, ready for lookup: vocabulary, fingerprints, and windows by length and hash."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.ids = [i for i, _ in items]
        split = [words(t) for _, t in items]
        self.vocab: dict[bytes, int] = {}
        for ws in split:
            for x in ws:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.hashes = np.concatenate([[X.U(0)], X.hash_words(list(self.vocab))])
        lens = np.array([len(w) for w in split], dtype=np.int64)
        self.flat = np.fromiter((self.vocab[x] for w in split for x in w), dtype=np.int64, count=int(lens.sum()))
        grams = X.Grams(self.hashes[self.flat])
        self.prints = np.unique(grams.all(K)[fingerprints(grams.all(K), X.runs_within(lens, SPAN), W)])
        #: length -> (sorted hashes, places, items), a place being where a window starts in flat
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        item, starts = np.repeat(np.arange(len(items)), lens), np.cumsum(lens) - lens
        for n in [SPAN, *sorted(set(lens[(lens > 0) & (lens < SPAN)].tolist()))]:
            at = np.flatnonzero(X.runs_within(lens, n)) if n == SPAN else starts[lens == n]
            h = grams.all(n)[at] if len(at) else np.zeros(0, dtype=X.U)
            order = np.argsort(h, kind="stable")
            self.windows[n] = (h[order], at[order], item[at[order]])

    def hits(self, at: np.ndarray, h: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of document windows at these places, those that are item windows (with repeats), and of which items."""
        hs, places, items = self.windows[n]
        a, b = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
        some = np.flatnonzero(b > a)
        at, a, c = at[some], a[some], (b - a)[some]
        to = np.repeat(a, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        at = np.repeat(at, c)
        same = np.ones(len(at), dtype=bool)
        for j in range(n):  # the words themselves, not their hashes
            same &= ids[at + j] == self.flat[places[to] + j]
        return at[same], items[to[same]]


def _match(shard: Shard, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[int]]]:
    """For each text: words, a mask of those hit, and the items hit."""
    split = [words(t) for t in texts]
    lens = np.array([len(w) for w in split], dtype=np.int64)
    get = shard.vocab.get
    ids = np.fromiter((get(x, 0) for w in split for x in w), dtype=np.int64, count=int(lens.sum()))
    grams = X.Grams(shard.hashes[ids])
    doc = np.repeat(np.arange(len(texts)), lens)
    hit = np.zeros(len(ids), dtype=bool)
    found: dict[int, set[int]] = defaultdict(set)
    for n in shard.windows:
        ok = X.runs_within(lens, n)
        if n == SPAN:
            g = grams.all(K)
            p = fingerprints(g, ok, W)
            p = p[np.isin(g[p], shard.prints)]
            at = np.unique((p[:, None] - np.arange(W)).ravel())
            at = at[(at >= 0) & (at < len(ok))]
        else:
            at = np.flatnonzero(ok)
        at = at[ok[at]]
        at, items = shard.hits(at, grams.all(n)[at], ids, n)
        for j in range(n):
            hit[at + j] = True
        for d, i in set(zip(doc[at].tolist(), items.tolist(), strict=True)):
            found[d].add(i)
    ends = np.cumsum(lens)
    for i, n in enumerate(lens):
        yield int(n), hit[ends[i] - n : ends[i]], found.get(i, set())


def _shards(benchmark: DataFrame, item_col: str, text_col: str, least: int = 1) -> Iterator[list[tuple[str | None, bytes]]]:
    part, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        text = (r[1] or "").encode()
        n = len(words(text))
        if part and size + n > SHARD_WORDS:
            yield part
            part, size = [], 0
        if n >= least:
            part.append((r[0], text))
            size += n
    yield part


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "contamination", least_words: int = 1) -> DataFrame:
    """docs with one column more: struct(n_words, hit_words array<int>, items array<string>), hit_words being indices from 0.

    Items of fewer than least_words words (1 at least) are left out. A column of docs named like the
    new one is replaced.
    """
    X.small_batches(docs.sparkSession)
    docs = docs.drop(out)
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    sc = docs.sparkSession.sparkContext
    at, names_in, width = docs.columns.index(text_col), [*docs.columns, out], len(docs.columns)
    done = docs
    for k, items in enumerate(_shards(benchmark, item_col, item_text_col, max(least_words, 1))):
        if k:
            done = materialize(done, "decontaminate")
        ship = sc.broadcast(items)
        schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])

        def run(batches: Iterator[pa.RecordBatch], ship=ship, first=not k) -> Iterator[pa.RecordBatch]:
            shard = Shard(ship.value)
            for b in batches:
                texts = X.as_bytes(b.column(at))
                for lo, hi in X.chunks(texts):
                    part, rows = b.slice(lo, hi - lo), []
                    before = [None] * (hi - lo) if first else part.column(part.num_columns - 1).to_pylist()
                    for old, (n, mask, found) in zip(before, _match(shard, texts[lo:hi]), strict=True):
                        at_words, names = np.flatnonzero(mask).tolist(), {shard.ids[i] for i in found} - {None}
                        if old:
                            at_words, names = sorted({*at_words, *old["hit_words"]}), names | {*old["items"]}
                        rows.append({"n_words": n, "hit_words": at_words, "items": sorted(names)})
                    t = pa.array(rows, pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], t], names=names_in)

        done = done.mapInArrow(X.fresh(run), schema)
    return done


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256 and contaminated (n_items >= min_items)."""
    c = F.col("contamination")

    def digest(items: Column) -> Column:
        return F.sha2(F.array_join(items, ","), 256)

    found = find_contamination(docs.select(F.col(id_col), F.col(text_col).alias("text")), benchmark)
    n = F.size(c["items"]).cast("long")
    return found.select(id_col, c["n_words"].alias("n_words"), F.size(c["hit_words"]).cast("long").alias("n_hit"), n.alias("n_items"), digest(c["items"]).alias("items_sha256"), (n >= min_items).alias("contaminated"))


def sha256_of(items: set[str]) -> str:
    """The digest that contamination_report gives for these item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
