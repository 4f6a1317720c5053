"""MinHash near-duplicate classes with tensored banding.

Two collections of short bands are hashed per document, m_left of r_left minhashes and m_right of
r_right; a table key joins one band of either, so m_left * m_right tables cost only
m_left * r_left + m_right * r_right minhashes. With the defaults (12 x 3 and 12 x 3) a pair of
Jaccard similarity 0.8 shares a key with probability (1 - (1 - 0.8**3)**12)**2 = 0.9996, one of
0.85 with 0.99998. Every pair that counts is confirmed on the full shingle sets.

Defined results: documents without words or text have no shingles and no links; fewer words than a
shingle make one shingle of the whole sequence; exact copies, found by a hash of their sets and
confirmed on the sets, are one node of the search; a row with
null id has a null component and is kept; rows that repeat an id are one node (linked where any of
its texts is). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as X
from graphloom.llm.idfilter import bloom, may_hold
from graphloom.operators.components import star_components
from graphloom.plans.scratch import materialize

#: Counters of shingle hashes that order the elements of differences, rarest first; their precision affects speed alone.
ORDER = 1 << 19
#: 64-bit words of a set's parity map. The maps of two sets differ in no more bits than the sets in elements.
MAP_WORDS = 16
#: Exact copies that one task compares with a copy of their head.
GROUP = 5000


def _sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, concatenated, and how many each has."""
    words = [X.split_lower(t) for t in texts]
    lens = np.array([len(w) for w in words], dtype=np.int64)
    grams = X.Grams(X.hash_words([x for w in words for x in w]))
    ends = np.cumsum(lens)
    ok = X.runs_within(lens, k)
    docs = np.repeat(np.arange(len(texts)), lens)
    short = np.flatnonzero((lens > 0) & (lens < k))
    h = np.concatenate([grams.all(k)[ok], grams.spans((ends - lens)[short], ends[short])])
    d = np.concatenate([docs[: len(ok)][ok], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[first], d[first]
    return h, np.bincount(d, minlength=len(texts)).astype(np.int64)


def _parities(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The parity map of each set: bit k tells whether an odd number of its hashes fall on k."""
    bits = MAP_WORDS * 64
    rows = np.repeat(np.arange(len(counts)), counts)
    odd = np.bincount(rows * bits + (h % X.U(bits)).astype(np.int64), minlength=len(counts) * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(percent: int, bits: tuple[str, str], n: tuple[str, str]) -> Column:
    """False only for sets that differ in more than a link of percent allows, by their maps and sizes."""
    differ = sum((F.bit_count(F.col(bits[0])[i].bitwiseXOR(F.col(bits[1])[i])) for i in range(1, MAP_WORDS)), F.bit_count(F.col(bits[0])[0].bitwiseXOR(F.col(bits[1])[0])))
    total = F.col(n[0]) + F.col(n[1])
    near = (100 + percent) * F.abs(F.col(n[0]) - F.col(n[1])) <= (100 - percent) * total
    return near & ((100 + percent) * differ <= (100 - percent) * total)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, only: np.ndarray | None = None) -> DataFrame:
    """(id, s, n, bits): sorted distinct 64-bit shingle hashes of each text, how many, and their parity map.

    only: a filter of ids by idfilter.bloom. Rows that are not in it go here, not in a Python node of
    their own before this one, as each such node of a stage keeps a worker beside every task.
    """
    ship = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if ship is not None:
                b = b.filter(pa.array(may_hold(ship.value, b.column(0))))
            texts = X.as_bytes(b.column(1))
            for lo, hi in X.chunks(texts):
                h, n = _sets(texts[lo:hi], shingle)
                bits = _lists(_parities(h, n), np.full(hi - lo, MAP_WORDS))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), _lists(X.i64(h), n), pa.array(n), bits], names=["id", "s", "n", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(X.fresh(run), "id long, s array<long>, n long, bits array<long>")


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: tuple[int, int], rows: tuple[int, int], seed: int) -> DataFrame:
    """(id, n, h1, h2, bands): set size, a 128-bit hash of the set, and the hashed bands of both collections."""
    rng = np.random.default_rng(seed)
    width = bands[0] * rows[0] + bands[1] * rows[1]
    mul = rng.integers(0, 1 << 63, width, dtype=np.int64).astype(X.U) * X.U(2) + X.U(1)
    add = rng.integers(0, 1 << 63, width, dtype=np.int64).astype(X.U)
    cuts = np.cumsum([0] + [rows[0]] * bands[0] + [rows[1]] * bands[1])[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = X.as_bytes(b.column(1))
            for lo, hi in X.chunks(texts):
                h, n = _sets(texts[lo:hi], shingle)
                full = np.flatnonzero(n)
                out = np.zeros((hi - lo, len(cuts)), dtype=X.U)
                h1, h2 = np.zeros(hi - lo, dtype=X.U), np.zeros(hi - lo, dtype=X.U)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    mins = np.empty((width, len(full)), dtype=X.U)
                    with np.errstate(over="ignore"):
                        for j in range(width):
                            v = h * mul[j] + add[j]
                            v ^= v >> X.U(32)  # the low bits of a product are weak
                            mins[j] = np.minimum.reduceat(v * X.U(0x9FB21C651E98DF25), at)
                        mixed = X.fmix(mins + np.arange(width, dtype=X.U)[:, None])
                        out[full] = X.fmix(np.add.reduceat(mixed, cuts, axis=0)).T
                        h1[full], h2[full] = np.add.reduceat(X.fmix(h), at), np.bitwise_xor.reduceat(X.fmix(h + X.U(77)), at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(X.i64(h1)), pa.array(X.i64(h2)), _lists(X.i64(out.ravel()), np.full(hi - lo, len(cuts)))],
                    names=["id", "n", "h1", "h2", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(X.fresh(run), "id long, n long, h1 long, h2 long, bands array<long>")


def _tensor(left: int) -> object:
    """One row (key, id) for each pair of a left and a right band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                v = np.asarray(part.column(1).flatten()).view(X.U).reshape(part.num_rows, -1)
                l, r = v[:, :left], v[:, left:]
                with np.errstate(over="ignore"):
                    key = X.fmix(X.fmix(l + np.arange(left, dtype=X.U))[:, :, None] + (r ^ X.U(0x5851F42D4C957F2D))[:, None, :] + np.arange(r.shape[1], dtype=X.U) * X.U(_STEP))
                n = key.shape[1] * key.shape[2]
                yield pa.RecordBatch.from_arrays([pa.array(X.i64(key.reshape(-1))), pa.array(np.repeat(np.asarray(part.column(0)), n))], names=["key", "id"])

    return run


_STEP = 0xD6E8FEB86659FD93


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, id), the members of keys that more than one id has, with the least id of their key."""
    last = None  # key and least id of the group that was open at the end of the batch before, and whether its head is out
    for b in batches:
        key, ids = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(key):
            continue
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        head[0] = last is None or key[0] != last[0]
        group = np.cumsum(head) - 1  # -1 belongs to the group that was open
        starts = np.flatnonzero(head)
        least = np.where(group >= 0, ids[starts[np.maximum(group, 0)]] if len(starts) else 0, last[1] if last else 0)
        rest = ~head & (ids != least)
        yield pa.RecordBatch.from_arrays([pa.array(key[rest]), pa.array(least[rest]), pa.array(ids[rest])], names=["key", "head", "id"])
        last = (key[-1], least[-1])


def _prefixes(a: np.ndarray, b: np.ndarray, percent: int, often: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether set b links with its head a; and, for the search inside a's family, two prefixes of what b differs by."""
    n, m = len(a), len(b)
    at = np.searchsorted(a, b)
    common = a[np.minimum(at, n - 1)] == b
    i = int(common.sum())
    linked = 100 * i >= percent * (n + m - i)
    lost = np.ones(n, dtype=bool)
    lost[at[common]] = False
    differ = np.concatenate([b[~common], a[lost]])
    differ = differ[np.lexsort((differ, often[(differ % X.U(len(often))).astype(np.int64)]))]  # one order for all, the rarest first
    d, c, q = len(differ), (100 - percent) / (100 + percent), percent / 100
    short = d - int(np.ceil((d + c * (n - m)) / 2 - 1e-9)) + 1
    long = 0 if linked else d - max(1, int(np.ceil(d - c * m * (1 + 1 / q) - 1e-9))) + 1
    return linked, differ[: max(short, 0)], differ[: max(long, 0)]


def _sets_of(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Full sets (id, s) of the documents in pairs (u, v)."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    ids = materialize(ids, "ids")
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    some = shingle_sets(wanted, "id", "t", shingle, bloom(ids))  # so only sets that may be wanted are made and shuffled
    X.small_batches(docs.sparkSession)
    return materialize(some.join(ids, "id", "left_semi"), "sets").where(F.size("s") > 0)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v, ...) with the sets a of u and b of v."""
    return pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    both = _with_sets(pairs, _sets_of(pairs, docs, id_col, text_col, shingle))
    n, m, i = F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b"))
    return both.where(100 * F.least(n, m) >= percent * F.greatest(n, m)).where(100 * i >= percent * (n + m - i)).select("u", "v").distinct()


def _same_as_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, same) from rows (head, salt, id, s) sorted by the first two, the head's own rows before the others."""
    at, own_sets = None, set()
    for b in batches:
        flat, ends = np.asarray(b.column(3).flatten()), np.cumsum(np.asarray(b.column(3).value_lengths()))
        rows = []
        for i, (head, salt, own) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
            s = flat[0 if not i else ends[i - 1] : ends[i]].tobytes()
            if at != (head, salt):
                at, own_sets = (head, salt), set()
            if own == head:
                own_sets.add(s)
            else:
                rows.append((head, own, s in own_sets))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["u", "v", "same"])


def confirmed_copies(copies: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(u, v, same): whether the full sets of v and its head u are equal. Groups above GROUP rows are dealt out by salt, each with the head's set."""
    salts = copies.groupBy("u").agg(F.count("*").alias("k")).where(F.col("k") > GROUP).select("u", F.ceil(F.col("k") / GROUP).cast("int").alias("salts"))
    some = copies.join(salts, "u", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    members = some.select(F.col("u").alias("head"), F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.col("v").alias("id"))
    heads = some.select("u", "salts").distinct().select(F.col("u").alias("head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("u").alias("id"))
    who = materialize(members.union(heads), "members")
    pairs = who.select(F.col("head").alias("u"), F.col("id").alias("v"))
    sets = _sets_of(pairs, docs, id_col, text_col, shingle).select("id", "s")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = who.join(sets, "id").select("head", "salt", "id", "s", (F.col("id") == F.col("head")).alias("own"))
    rows = rows.repartition(parts, "head", "salt").sortWithinPartitions("head", "salt", F.desc("own")).select("head", "salt", "id", "s")
    return rows.mapInArrow(X.fresh(_same_as_head), "u long, v long, same boolean").groupBy("u", "v").agg(F.max("same").alias("same"))  # an id may have several texts


def rarities(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, by hash modulo ORDER; what is rarer than 4 counts as 0."""
    hashes = sets.select(F.explode("s").alias("t")).select(F.pmod("t", F.lit(ORDER)).alias("t"))
    counts = hashes.groupBy("t").count().where("count >= 4").toArrow()  # ORDER rows at most
    often = np.zeros(ORDER, dtype=np.int32)
    often[np.asarray(counts.column("t"), dtype=np.int64)] = np.minimum(np.asarray(counts.column("count")), 1 << 30)
    return often


def _plain_prefixes(sets: DataFrame, percent: int, ship: object) -> DataFrame:
    """(v, n, bits, t): the rarest shingles of each set, as many as a link must not leave all out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = ship.value
        for b in batches:
            flat, n = np.asarray(b.column(1).flatten()).view(X.U), np.asarray(b.column(1).value_lengths())
            ends, parts = np.cumsum(n), []
            for i, k in enumerate(n):
                x = flat[ends[i] - k : ends[i]]
                parts.append(x[np.lexsort((x, often[(x % X.U(ORDER)).astype(np.int64)]))][: k + (-percent * int(k)) // 100 + 1])
            took = np.array([len(x) for x in parts], dtype=np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), took))
            own = [b.column(k).take(at) for k in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(X.i64(np.concatenate([np.zeros(0, dtype=X.U), *parts])))], names=["v", "n", "bits", "t"])

    return sets.select(F.col("id").alias("v"), "s", "n", "bits").mapInArrow(X.fresh(run), "v long, n long, bits array<long>, t long")


def judged(pairs: DataFrame, sets: DataFrame, percent: int, ship: object) -> DataFrame:
    """(u, v, linked, short, long) of pairs (u, v, family): the prefixes are empty where family is false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = (np.asarray(b.column(k).flatten()).view(X.U) for k in (3, 4))  # the order they were sorted in
            ue, ve = (np.cumsum(np.asarray(b.column(k).value_lengths())) for k in (3, 4))
            got = [_prefixes(us[0 if not r else ue[r - 1] : ue[r]], vs[0 if not r else ve[r - 1] : ve[r]], percent, ship.value) for r in range(b.num_rows)]
            keep = np.asarray(b.column(2))
            lists = []
            for k in (1, 2):
                parts = [g[k] if f else g[k][:0] for g, f in zip(got, keep, strict=True)]
                lists.append(_lists(X.i64(np.concatenate([np.zeros(0, dtype=X.U), *parts])), np.array([len(x) for x in parts], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.bool_()), *lists], names=["u", "v", "linked", "short", "long"])

    both = _with_sets(pairs, sets).select("u", "v", "family", "a", "b")  # ship: broadcast rarities
    return both.mapInArrow(X.fresh(run), "u long, v long, linked boolean, short array<long>, long array<long>")


def within_families(tried: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, ship: object) -> DataFrame:
    """Pairs (u, v) of different classes that may link though neither is the other's head.

    All docs that share a key lie in the family of that key's least id, the head. Two exact prefix
    joins find what may link. Where at least half of a family links with its head, a doc stands for
    its symmetric difference from the head; two docs differ by the difference of those. With
    c = (1 - q) / (1 + q) for similarity q, a link needs |x ^ y| <= c (|x| + |y|), while a doc that
    doesn't link with the head differs from it by more than c (|y| + |head|): together they bound from
    below what both differences share, so their first elements, as many as the bound leaves, meet.
    Docs of other families are akin by a passage and otherwise unlike: of their plain sets, links must
    share q of the larger, so their rarest elements meet. Rarest first, docs seldom meet for less.
    Of docs that meet, may_link leaves out those whose parity maps prove that they differ by too much.
    """
    c = comp.withColumnsRenamed({"node": "v", "component": "c"})
    rows = tried.where(F.size("short") + F.size("long") > 0).join(c, "v", "left").withColumn("c", F.coalesce("c", "v"))
    kind = rows.groupBy("u").agg(F.min("c").alias("x"), F.max("c").alias("y"), (2 * F.sum(F.col("linked").cast("int")) >= F.count("*")).alias("close")).where("x <> y").select("u", "close")
    maps = sets.select(F.col("id").alias("v"), "n", "bits")
    rows = materialize(rows.join(kind, "u").join(maps, "v"), "families")
    other = {"v": "w", "c": "d", "n": "m", "bits": "map"}
    may = may_link(percent, ("bits", "map"), ("n", "m")) & F.expr("c <> d")
    near = rows.where("close").select("u", "v", "c", "n", "bits", "linked", F.explode("short").alias("t"))
    long = rows.where("close").select("u", "v", "c", "n", "bits", F.explode("long").alias("t")).withColumnsRenamed(other)
    apart = near.where("NOT linked").drop("linked").withColumnsRenamed(other)
    meet = near.where("linked").join(long, ["u", "t"]).where(may).select("v", "w")
    meet = meet.union(near.where("NOT linked").join(apart, ["u", "t"]).where(may & F.expr("v < w")).select("v", "w"))
    loose = rows.where("NOT close").select("v", "c").distinct()
    plain = _plain_prefixes(sets.join(loose.select(F.col("v").alias("id")), "id", "left_semi"), percent, ship).join(loose, "v")
    mixed = plain.groupBy("t").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("t")
    plain = plain.join(mixed, "t", "left_semi")
    meet = meet.union(plain.join(plain.withColumnsRenamed(other), "t").where(may & F.expr("v < w")).select("v", "w"))
    return meet.select(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, bands: tuple[int, int] = (12, 12), rows: tuple[int, int] = (3, 3), seed: int = 11
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept (it is the least id of its class).

    The ids that share a key are compared with the least of them, its head; links between others are
    then sought by within_families, so that no pair that shares a key is lost and none is enumerated
    for sharing keys alone.
    """
    X.small_batches(docs.sparkSession)
    sigs = materialize(signatures(docs, id_col, text_col, shingle, bands, rows, seed), "sigs")
    real = sigs.where("n > 0 AND id IS NOT NULL")
    classes = materialize(real.groupBy("h1", "h2").agg(F.min("id").alias("head"), F.first("bands").alias("bands")), "exact")
    keys = classes.select(F.col("head").alias("id"), "bands").mapInArrow(X.fresh(_tensor(bands[0])), "key long, id long")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    live = materialize(keys.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(X.fresh(_shared), "key long, head long, id long"), "live")
    copies = real.join(classes.select("h1", "h2", "head"), ["h1", "h2"]).where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v")).distinct()
    copies = materialize(confirmed_copies(materialize(copies, "copies"), docs, id_col, text_col, shingle), "same")
    several = live.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    sized = live.join(several, "key", "left").groupBy(F.col("head").alias("u"), F.col("id").alias("v")).agg(F.max(F.col("k").isNotNull()).alias("family"))
    unlike = copies.where("NOT same").select("u", "v", F.lit(False).alias("family"))  # equal hashes of different sets: pairs like others
    sized = materialize(sized.union(unlike), "pairs")
    sets = _sets_of(sized, docs, id_col, text_col, shingle)
    ship = docs.sparkSession.sparkContext.broadcast(rarities(sets))
    tried = materialize(judged(sized, sets, percent, ship), "tried")
    links = materialize(tried.where("linked").select("u", "v").union(copies.where("same").select("u", "v")), "links")
    comp = materialize(star_components(links, "u", "v"), "comp")
    more = materialize(within_families(tried, comp, sets, percent, ship), "more")
    if not more.isEmpty():
        found = confirmed(more, docs, id_col, text_col, shingle, percent)
        comp = star_components(links.union(found), "u", "v")
    out = sigs.select("id", "n").join(comp.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
