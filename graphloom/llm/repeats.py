"""Removal of long repeated passages by repeated-phrase automata.

A window is SPAN successive words of one document. The least of its k-gram hashes (K words) is its
anchor; equal windows have equal anchors, and the windows of a document that share an anchor place
form a segment of at most SPAN - K + 1 windows. So the work is dealt out by anchor:

1. Candidates: every document gives one row per segment (anchor, place). Anchors that occur once are
   dropped by a pre-aggregated count and a join. Anchors that hold over 1 / HOT_SHARE of all segments
   are fewer than HOT_SHARE; they meet their rows by a broadcast and are dealt out by salt.
2. The words of the segments left are cut out of the texts, once for rows that repeat an id and a text.
3. Confirmation, by words: equal segments are counted (aggregated before the shuffle). Where the
   segments of an anchor differ, their windows are counted: within one task for up to MANY segments
   of an anchor, in a distributed aggregation beyond, with the same result.
4. Location: the confirmed phrases of about PHRASES segments make one shard, compiled as an
   Aho-Corasick automaton over word numbers. All segments of all documents of the shard's anchors are
   streamed through it, which gives every occurrence. Shards of hot anchors are copied to each salt.
5. Each document is joined with its occurrences, and the words they cover go.

Defined results: a null or empty text has no words; texts below SPAN words lose none; rows that
repeat an id and a text count as so many documents; null ids are kept apart by text; without rows
there are none; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as X
from graphloom.plans.scratch import discard, materialize

SPAN, K = 35, 8
W = SPAN - K + 1
#: An anchor is hot from this part of all segments on.
HOT_SHARE = 2000
#: Differing segments of one anchor whose windows one task counts.
MANY = 2000
#: Confirmed phrases for which one automaton is compiled, about.
PHRASES = 4000
_POS = 26  # bits for a place within a block of windows
_BLOCK = (1 << _POS) - W


def _lowest(g: np.ndarray) -> np.ndarray:
    """For every run of W k-grams, the place of its leftmost least one."""
    parts = []
    for lo in range(0, max(len(g) - W + 1, 0), _BLOCK):
        x = g[lo : lo + _BLOCK + W - 1]
        place = (x & ~X.U((1 << _POS) - 1)) | np.arange(len(x), dtype=X.U)
        parts.append((X.sliding_min(place, W) & X.U((1 << _POS) - 1)).astype(np.int64) + lo)
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts])


def _segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Document, first window, windows and anchor hash of every segment."""
    split = [X.split_space(t) for t in texts]
    lens = np.array([len(w) for w in split], dtype=np.int64)
    ok = X.runs_within(lens, SPAN)
    if not ok.any():
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    g = X.Grams(X.hash_words([x for w in split for x in w])).all(K)
    at = np.flatnonzero(ok)
    low = _lowest(g)[at]
    head = np.ones(len(at), dtype=bool)
    head[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(head)
    start, n = at[i], np.diff(np.append(i, len(at)))
    doc = np.repeat(np.arange(len(texts)), lens)[start]
    return doc, start - (np.cumsum(lens) - lens)[doc], n, X.i64(g[low[i]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = X.as_bytes(b.column(1))
        for lo, hi in X.chunks(texts):
            doc, start, n, anchor = _segments(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + lo)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int8)), pa.array(anchor)], names=["rid", "start", "n", "anchor"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted segments of each text."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    for b in batches:
        for rid, text, wanted, copies in zip(b.column(0).to_pylist(), X.as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            w = X.split_space(text)
            rows = [(rid, copies, x["start"], x["anchor"], x["salt"], b" ".join(w[x["start"] : x["start"] + x["n"] + SPAN - 1])) for x in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["rid", "copies", "start", "anchor", "salt", "words"])


def _recurring(segments: list[tuple[bytes, bool]]) -> Iterator[bytes]:
    """Phrases all of whose windows recur among differing segments (words, whether they recur as they are); no window comes twice."""
    seqs = [words.split() for words, _ in segments]
    seen: Counter = Counter()
    for s, (_, twice) in zip(seqs, segments, strict=True):
        for i in range(len(s) - SPAN + 1):
            seen[tuple(s[i : i + SPAN])] += 1 + twice
    for s in seqs:
        first = None
        for i in range(len(s) - SPAN + 2):
            good = i < len(s) - SPAN + 1 and seen[tuple(s[i : i + SPAN])] > 1
            if good:
                seen[tuple(s[i : i + SPAN])] = 0  # it has been told
                first = i if first is None else first
            elif first is not None:
                yield b" ".join(s[first : i - 1 + SPAN])
                first = None


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, words, whole) of confirmed phrases from rows (anchor, words, twice) sorted by anchor. whole: the anchor has this segment alone."""
    group: list[tuple[bytes, bool]] = []
    last = None

    def told() -> list[tuple[int, bytes, bool]]:
        if len(group) == 1:
            return [(last, group[0][0], True)] if group[0][1] else []
        return [(last, x, False) for x in _recurring(group)]

    def batch(rows: list[tuple[int, bytes, bool]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["anchor", "words", "whole"])

    for b in batches:
        out = []
        for anchor, words, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if anchor != last and group:
                out += told()
                group.clear()
            last = anchor
            group.append((words, twice))
        yield batch(out)
    if group:
        yield batch(told())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, words, copies) of every window of the segments (anchor, words, twice)."""
    for b in batches:
        for anchor, words, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
            s = words.split()
            rows = [b" ".join(s[i : i + SPAN]) for i in range(len(s) - SPAN + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([anchor] * len(rows), pa.int64()), pa.array(rows, pa.binary()), pa.array([1 + twice] * len(rows), pa.int32())], names=["anchor", "words", "copies"])


class Shard:
    """An automaton of phrases over word numbers."""

    def __init__(self) -> None:
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.phrases = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.ready = False
        self.known: dict[bytes, list[tuple[int, int]]] = {}

    def add(self, words: bytes, whole: bool) -> None:
        """A phrase: as it is, or window by window."""
        s = tuple(self.number.setdefault(x, len(self.number) + 1) for x in words.split())
        for p in [s] if whole else [s[i : i + SPAN] for i in range(len(s) - SPAN + 1)]:
            self.phrases.add_word(p)

    def covered(self, words: bytes) -> list[tuple[int, int]]:
        """Ranges of words that phrases cover."""
        if not self.number:
            return []
        if words in self.known:  # copies of a passage
            return self.known[words]
        if not self.ready:
            self.phrases.make_automaton()
            self.ready = True
        out: list[tuple[int, int]] = []
        get = self.number.get
        for end, n in self.phrases.iter(tuple(get(x, 0) for x in words.split())):
            a = end - n + 1
            while out and a <= out[-1][1]:
                a = min(a, out.pop()[0])
            out.append((a, end + 1))
        if len(self.known) < PHRASES:
            self.known[words] = out
        return out


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, a, b) from rows (shard, salt, kind, words, whole, rid, start) sorted by the first three: phrases come before segments."""
    at, shard = None, None
    for b in batches:
        rows = []
        for number, salt, kind, words, whole, rid, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (number, salt):
                at, shard = (number, salt), Shard()
            if kind:
                rows += [(rid, start + x, start + y) for x, y in shard.covered(words)]
            else:
                shard.add(words, whole)
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["rid", "a", "b"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, marks in zip(X.as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            w = X.split_space(text)
            if not marks:
                rows.append((len(w), 0, b" ".join(w)))
                continue
            edge = np.zeros(len(w) + 1, dtype=np.int64)
            ends = np.array([(m["a"], m["b"]) for m in marks], dtype=np.int64)
            np.add.at(edge, ends[:, 0], 1)
            np.add.at(edge, ends[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            rows.append((len(w), int(gone.sum()), b" ".join([x for x, y in zip(w, gone.tolist(), strict=True) if not y])))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())], names=["id", "n_words", "n_removed", "kept"]
        )


def confirmed_phrases(cut: DataFrame, parts: int) -> DataFrame:
    """(anchor, words, whole) of the phrases that recur in cut (anchor, words, copies)."""
    told = materialize(cut.groupBy("anchor", "words").agg((F.sum("copies") > 1).alias("twice")), "told")
    many = told.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > MANY).select("anchor")
    few = told.join(many, "anchor", "left_anti").select("anchor", "words", "twice").repartition(parts, "anchor").sortWithinPartitions("anchor")
    out = few.mapInArrow(_confirm, "anchor long, words binary, whole boolean")
    spread = told.join(many, "anchor", "left_semi").select("anchor", "words", "twice").mapInArrow(_windows, "anchor long, words binary, copies int")
    again = spread.groupBy("anchor", "words").agg(F.sum("copies").alias("c")).where("c > 1")
    phrases = materialize(out.union(again.select("anchor", "words", F.lit(True).alias("whole"))), "phrases")
    discard(told)
    return phrases


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept (the words left, joined by a space)."""
    X.small_batches(docs.sparkSession)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("rid", F.xxhash64("id", "text"))
    occ = materialize(base.select("rid", "text").mapInArrow(_scan, "rid long, start int, n byte, anchor long"), "segments")
    total = occ.count()
    per = materialize(occ.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "anchors")
    salts = F.ceil(F.col("k") * parts / max(total, 1)).cast("int")  # so that no salt of an anchor has more rows than an average task
    hot = F.broadcast(per.where(F.col("k") > max(total // HOT_SHARE, 1)).select("anchor", salts.alias("salts")))  # fewer than HOT_SHARE
    cool = occ.join(hot, "anchor", "left_anti").join(per.select("anchor"), "anchor", "left_semi").withColumn("salt", F.lit(0))
    warm = occ.join(hot, "anchor").withColumn("salt", F.pmod(F.xxhash64("rid", "start"), F.col("salts")).cast("int"))
    place = F.struct("start", F.col("n").cast("int").alias("n"), "anchor", "salt")
    lists = cool.union(warm.select(cool.columns)).groupBy("rid").agg(F.collect_set(place).alias("wanted"), F.count("*").alias("k"))
    lists = lists.select("rid", "wanted", (F.col("k") / F.size("wanted")).cast("long").alias("copies"))
    texts = base.join(lists, "rid").select("rid", "text", "wanted", "copies").dropDuplicates(["rid"])
    cut = materialize(texts.mapInArrow(_cut_out, "rid long, copies long, start int, anchor long, salt int, words binary"), "cut")
    discard(occ)
    phrases = confirmed_phrases(cut, parts)
    shards = max(parts, -(-phrases.count() // PHRASES))
    number = F.pmod(F.xxhash64("anchor", F.lit(5)), F.lit(shards)).alias("shard")
    salted = phrases.join(hot, "anchor", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    none = F.lit(None).cast("long").alias("rid"), F.lit(0).alias("start")
    rows = salted.select(number, "salt", F.lit(0).alias("kind"), "words", "whole", *none)
    rows = rows.union(cut.select(number, "salt", F.lit(1).alias("kind"), "words", F.lit(False).alias("whole"), "rid", "start"))
    found = rows.repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_locate, "rid long, a int, b int")
    marks = found.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    out = base.select("id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema
    return base.join(marks, "rid", "left").select("id", "text", "marks").mapInArrow(_strip, out).withColumnRenamed("id", id_col)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """remove_repeats with the SHA-256 of the kept words in place of them."""
    return remove_repeats(docs, id_col, text_col).select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def kept_digest(kept: list[bytes]) -> str:
    """The digest of removal_report for these words."""
    return hashlib.sha256(b" ".join(kept)).hexdigest()
