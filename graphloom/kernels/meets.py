"""What neighbour lists share, by a grid of tasks: every task holds the lists of one part of the nodes and meets them with the lists of another, so that wedges are never written or shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import materialize

#: Entries of lists that one task holds of either side at most, but for chance; more parts are made beyond it.
PART_ENTRIES = 30_000_000
#: Marks held at once in a task, and wedges looked at in one step.
MARKS, WEDGES = 1 << 24, 1 << 22


def _parts(entries: int) -> int:
    """Parts of either side: lists are sent that many times, so no more than tasks and their memory need."""
    return max(-(-entries // PART_ENTRIES), min(8, 1 + int((entries / 100_000) ** 0.5)))


def _part(c: Column | str, k: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(k)).cast("int")


def _lists(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    c = t.column(name).combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
    return np.diff(c.offsets.to_numpy()), c.flatten().to_numpy(zero_copy_only=False)


def _packed(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    """Sorted lists of lengths as bytes: the first value with its sign in the last bit, then differences, seven bits a byte. About a third of their size as numbers."""
    x = values.astype(np.int64)
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    d = np.diff(x, prepend=0)
    d[first] = (x[first] << 1) ^ (x[first] >> 63)
    d = d.view(np.uint64)
    size = np.ones(len(d), dtype=np.int64)
    for i in range(1, 10):
        more = d >= np.uint64(1 << (7 * i))
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out, start = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8), end - size
    for i in range(int(size.max(initial=0))):
        on = size > i
        out[start[on] + i] = ((d[on] >> np.uint64(7 * i)) & np.uint64(127)) | np.where(size[on] > i + 1, np.uint64(128), np.uint64(0))
    offsets = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a column of packed lists, or of lists as they are."""
    if pa.types.is_list(t.schema.field(name).type):
        return _lists(t, name)
    c = t.column(name).combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
    _, offsets, data = c.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[c.offset : c.offset + len(c) + 1]
    x = np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    end = np.flatnonzero(x < 128) + 1
    start = np.concatenate([[0], end[:-1]])
    size, d = end - start, np.zeros(len(end), dtype=np.uint64)
    for i in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > i)
        d[on] |= (x[start[on] + i].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * i)
    lengths = np.diff(np.searchsorted(end, offsets - offsets[0], side="right"))
    first, some = np.cumsum(lengths) - lengths, lengths > 0
    f = d[first[some]]
    d = d.view(np.int64)
    d[first[some]] = (f >> np.uint64(1)).view(np.int64) ^ -(f & np.uint64(1)).view(np.int64)
    total = np.cumsum(d)
    before = total[first[some]] - d[first[some]]
    values = total - np.repeat(before, lengths[some])
    return lengths, values.astype(np.int32) if len(values) and -(2**31) <= values.min() and values.max() < 2**31 else values


def _pack_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b])
        near = _packed(*_lists(t, "near"))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), near], names=["node", "to", "near"])


def _at(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x lies; -1 where it doesn't."""
    if not len(sorted_values):
        return np.full(len(x), -1, dtype=np.int64)
    i = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[i] == x, i, -1)


class _Rows:
    """The lists that a task looks up: row i has the values values[near[ptr[i]:ptr[i + 1]]]."""

    def __init__(self, nodes: np.ndarray, lengths: np.ndarray, near: np.ndarray):
        order = np.argsort(nodes, kind="stable")
        start = np.cumsum(lengths) - lengths
        self.nodes, lengths = nodes[order], lengths[order]
        self.ptr = np.concatenate([[0], np.cumsum(lengths)])
        self.of = np.repeat(start[order] - self.ptr[:-1], lengths) + np.arange(len(near))  # places before sorting
        self.values, inverse = np.unique(near, return_inverse=True)
        self.near = inverse.reshape(-1).astype(np.int32)[self.of]


def _steps(rows: _Rows, owner: np.ndarray, row: np.ndarray, lengths: np.ndarray, near: np.ndarray, places: bool = False) -> Iterator[tuple]:
    """Owner i has a list of lengths[i] in near; pair j asks what the lists of owner[j] and row[j] share. Owners rise. Yields (pairs i to j, marked places of near and their marks, wedges of each pair, and of each wedge its place in rows, its mark and how often the owner's list has it; if places, instead its place in near, counted from the first owner's and from 1)."""
    ptr = np.concatenate([[0], np.cumsum(lengths)])
    where = _at(rows.values, near)
    width = max(len(rows.values), 1)
    most = max(MARKS // width, 1)
    mark = np.zeros(most * width, dtype=np.int32)
    wedges = np.cumsum(rows.ptr[row + 1] - rows.ptr[row])
    i = 0
    while i < len(row):
        j = int(np.searchsorted(wedges, (wedges[i - 1] if i else 0) + WEDGES, side="right"))
        j = max(min(j, int(np.searchsorted(owner, owner[i] + most))), i + 1)
        lo, hi = owner[i], owner[j - 1] + 1
        place = np.arange(ptr[lo], ptr[hi])
        base = np.repeat(np.arange(hi - lo), lengths[lo:hi])
        ok = where[place] >= 0
        place, key = place[ok], base[ok] * width + where[place[ok]]
        if places:
            mark[key] = place - ptr[lo] + 1
        else:
            np.add.at(mark, key, 1)
        r = row[i:j]
        k = rows.ptr[r + 1] - rows.ptr[r]
        at = np.repeat(rows.ptr[r] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        seen = np.repeat((owner[i:j] - lo) * width, k) + rows.near[at]
        yield i, j, place, key, k, at, seen, mark[seen]
        mark[key] = 0
        i = j


def _sums(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of lengths k."""
    out = np.zeros(len(k), dtype=x.dtype)
    some = k > 0
    if some.any():
        out[some] = np.add.reduceat(x, (np.cumsum(k) - k)[some])
    return out


def _triangle_task(what: str):
    names = {"triples": "abc", "edges": ("a", "b", "t"), "nodes": ("node", "t")}[what]

    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not asks.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        hl, hv = _unpacked(held, "held_near")
        al, av = _unpacked(asks, "near")
        rows = _Rows(held.column("held").to_numpy(), hl, hv)
        nodes = asks.column("node").to_numpy()
        b = _at(rows.nodes, av)
        pick = np.flatnonzero(b >= 0)
        owner, row = np.repeat(np.arange(len(nodes)), al)[pick], b[pick]
        out: list[tuple] = []
        by_held, by_value, by_ask = np.zeros(len(rows.near), dtype=np.int64), np.zeros(len(rows.values), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        acc = np.zeros(max(MARKS // max(len(rows.values), 1), 1) * max(len(rows.values), 1), dtype=np.int64) if what == "edges" else None
        held_row = np.repeat(np.arange(len(rows.nodes)), np.diff(rows.ptr))
        for i, j, place, key, k, at, seen, hits in _steps(rows, owner, row, al, av):
            z = np.flatnonzero(hits)
            if not len(z):
                continue
            if what == "triples":
                pair = np.repeat(np.repeat(np.arange(i, j), k)[z], hits[z])
                out.append((nodes[owner[pair]], rows.nodes[row[pair]], rows.values[np.repeat(rows.near[at[z]], hits[z])]))
                continue
            np.add.at(by_held, at[z], hits[z])
            s = _sums(hits.astype(np.int64), k)
            if what == "nodes":
                np.add.at(by_ask, owner[i:j], s)
                continue
            np.add.at(acc, seen[z], hits[z])
            some = np.flatnonzero(s)
            out.append((nodes[owner[i + some]], rows.nodes[row[i + some]], s[some]))
            first = np.unique(key, return_index=True)[1]  # of parallel edges one
            got = first[acc[key[first]] > 0]
            at_list = np.searchsorted(np.cumsum(al), place[got], side="right")
            out.append((nodes[at_list], av[place[got]], acc[key[got]]))
            acc[key] = 0
        if what == "edges":
            z = np.flatnonzero(by_held)
            out.append((rows.nodes[held_row[z]], rows.values[rows.near[z]], by_held[z]))
        elif what == "nodes":
            np.add.at(by_value, rows.near, by_held)
            by_row = _sums(by_held, np.diff(rows.ptr))
            for ids, t in ((nodes, by_ask), (rows.nodes, by_row), (rows.values, by_value)):
                out.append((ids[t > 0], t[t > 0]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(len(names))]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, cols, strict=True)})

    return run


def _type(arcs: DataFrame, *cols: str) -> tuple[int, str]:
    """How many rows, and the narrower of two types that holds the ids."""
    f = arcs.agg(F.count("*"), *(x for c in cols for x in (F.min(c), F.max(c)))).first()
    ids = [x for x in f[1:] if x is not None]
    return f[0], "int" if not ids or (min(ids) >= -(2**31) and max(ids) < 2**31) else "long"


def _everywhere(lists: DataFrame, k: int, *names: str) -> DataFrame:
    """Lists of nodes for every task of their part, under names of their own: a join with the result may not confuse them with those of the other side."""
    fresh = [F.col("node").alias("held"), *(F.col(n).alias(f"held_{n}") for n in names)]
    return lists.select(_part("node", k).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("s"), *fresh)


def triangles(arcs: DataFrame, what: str) -> DataFrame:
    """Of arcs(a, b) that rise in some order of the nodes: triples (a, b, c), or counts of triangles: edges (a, b, t), several rows an edge, or nodes (node, t), several rows a node."""
    m, kind = _type(arcs, "a", "b")
    k = _parts(m)
    lists = arcs.groupBy(F.col("a").cast(kind).alias("node")).agg(F.array_sort(F.collect_list(F.col("b").cast(kind))).alias("near"))
    lists = lists.select("node", F.array_distinct(F.transform("near", lambda x: _part(x, k))).alias("to"), "near").mapInArrow(_pack_lists, f"node {kind}, to array<int>, near binary")
    held = _everywhere(lists, k, "near")
    asks = lists.select(F.explode("to").alias("p"), _part("node", k).alias("s"), "node", "near")
    schema = {"triples": "a long, b long, c long", "edges": "a long, b long, t long", "nodes": "node long, t long"}[what]
    return asks.groupBy("p", "s").cogroup(held.groupBy("p", "s")).applyInArrow(_triangle_task(what), schema)


def _upto(ranks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """In the layout of the lists: how many of a list have a rank of at most 0, 1, 2, ..."""
    start = np.cumsum(lengths) - lengths
    total = np.cumsum(np.bincount(np.repeat(start, lengths) + ranks, minlength=len(ranks)))
    return total - np.repeat(start, lengths)


def _rank_of(nodes: np.ndarray, lengths: np.ndarray, near: np.ndarray, ranks: np.ndarray, u: np.ndarray, v: np.ndarray, never: int) -> np.ndarray:
    """The rank of each v in the list of u; never where it isn't there. Nodes are sorted, and so is each list."""
    ids = np.unique(np.concatenate([near, v]))
    key = np.repeat(np.arange(len(nodes)), lengths) * len(ids) + np.searchsorted(ids, near)
    at = _at(key, np.searchsorted(nodes, u) * len(ids) + np.searchsorted(ids, v))
    return np.where(at >= 0, ranks[at], never) if len(ranks) else np.full(len(u), never)


def _pair_task(what: str):
    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not asks.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("u", pa.int64()), ("v", pa.int64()), ("common", pa.int64()), ("s", pa.float64()), ("t", pa.float64()))})
        hl, hv = _lists(held, "held_near")
        rows = _Rows(held.column("held").to_numpy(), hl, hv)
        tag = _lists(held, "held_tag")[1][rows.of]
        sent = np.argsort(asks.column("node").to_numpy(), kind="stable")
        asks = asks.take(pa.array(sent))
        nodes = asks.column("node").to_numpy()
        al, av = _lists(asks, "near")
        tl, tv = _lists(asks, "targets")
        row, owner = _at(rows.nodes, tv), np.repeat(np.arange(len(nodes)), tl)
        owner, row, tv = owner[row >= 0], row[row >= 0], tv[row >= 0]
        ptr, size = np.concatenate([[0], np.cumsum(al)]), np.diff(rows.ptr)
        if what == "neighbours":
            # 1 / ln tag in two parts whose sums are exact in any order, so that the whole sum is rounded once
            few, of = np.unique(tag, return_inverse=True)
            log = np.array([math.log(x) for x in few.tolist()])
            with np.errstate(divide="ignore", invalid="ignore"):
                worth = 1 / log
                high = np.where(np.isfinite(worth), np.floor(worth * 2**26) / 2**26, worth)
                parts = high[of.reshape(-1)], np.where(np.isfinite(worth), worth - high, 0.0)[of.reshape(-1)], 1 / tag
        if what == "prefix":
            ranks = _lists(asks, "tag")[1]
            mine, theirs = _upto(ranks, al), _upto(tag, size)
            never = np.iinfo(np.int32).max
            own, other = _rank_of(nodes, al, av, ranks, nodes[owner], tv, never), _rank_of(rows.nodes, size, rows.values[rows.near], tag, tv, nodes[owner], never)
        common, s, t = np.zeros(len(row), dtype=np.int64), np.zeros(len(row)), np.zeros(len(row))
        for i, j, place, key, k, at, seen, hits in _steps(rows, owner, row, al, av, places=what == "prefix"):
            common[i:j] = _sums((hits > 0).astype(np.int64), k)
            z = np.flatnonzero(hits)
            if what == "sum":
                s[i:j] = _sums(np.where(hits > 0, tag[at], 0.0), k)
            elif what == "neighbours":
                a, b, t[i:j] = (_sums(np.where(hits > 0, x[at], 0.0), k) for x in parts)
                s[i:j] = a + b
            elif what == "prefix" and len(z):
                pair = np.repeat(np.arange(i, j), k)[z]
                both = np.maximum(ranks[ptr[owner[i]] + hits[z] - 1], tag[at[z]]).astype(np.int64)
                order = np.sort((pair - i) << 32 | both)
                pair, both = (order >> 32) + i, order & ((1 << 32) - 1)
                last = np.flatnonzero(np.append(np.diff(order) > 0, True))  # ties enter together
                first = np.cumsum(common[i:j]) - common[i:j]
                pair, both, c = pair[last], both[last], last + 1 - first[pair[last] - i]
                o, r = owner[pair], row[pair]
                n = mine[ptr[o] + np.minimum(both, al[o] - 1)] + theirs[rows.ptr[r] + np.minimum(both, size[r] - 1)]
                n = n - (both >= own[pair]) - (both >= other[pair]) - c
                np.maximum.at(s, pair, c / n)
        return pa.table({"u": nodes[owner].astype(np.int64), "v": tv.astype(np.int64), "common": common, "s": s, "t": t})

    return run


def of_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, what: str) -> DataFrame:
    """(u, v, common, s, t) of different pairs(u, v): how many x the lists left(node, x, tag) of u and right(node, x, tag) of v share, each x once in a list. neighbours: s and t are the sums of 1 / ln tag and 1 / tag; sum: s is the sum of the tags; prefix: s is the largest Jaccard index of beginnings, tag being ranks from 0, both ends left out."""
    entries, a = _type(left, "node", "x")
    more, b = _type(right, "node", "x")
    pairs = materialize(pairs.select("u", "v").distinct(), "pairs")
    kind, k = "long" if "long" in (a, b) else "int", _parts(max(entries, more, pairs.count()))
    tags = {"neighbours": "long", "prefix": "int", "count": "int", "sum": "int"}[what]

    def lists(df: DataFrame) -> DataFrame:
        both = F.sort_array(F.collect_list(F.struct(F.col("x").cast(kind).alias("x"), F.col("tag").cast(tags).alias("tag"))))
        return df.groupBy(F.col("node").cast(kind).alias("node")).agg(both.alias("l")).select("node", F.col("l.x").alias("near"), F.col("l.tag").alias("tag"))

    q = pairs.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("v"))
    q = q.groupBy("node", _part("v", k).alias("p")).agg(F.collect_list("v").alias("targets"))
    asks = q.join(lists(left), "node").select("p", _part("node", k).alias("s"), "node", "targets", "near", "tag")
    return asks.groupBy("p", "s").cogroup(_everywhere(lists(right), k, "near", "tag").groupBy("p", "s")).applyInArrow(_pair_task(what), "u long, v long, common long, s double, t double")


def _step_task(asks: pa.Table, held: pa.Table) -> pa.Table:
    if not asks.num_rows or not held.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in ("u", "v", "n")})
    hl, hv = _lists(held, "held_near")
    rows = _Rows(held.column("held").to_numpy(), hl, hv)
    nodes = asks.column("node").to_numpy()
    al, av = _lists(asks, "near")
    row, owner = _at(rows.nodes, av), np.repeat(np.arange(len(nodes)), al)
    owner, row = owner[row >= 0], row[row >= 0]
    width, size = len(rows.values), np.diff(rows.ptr)
    wedges = np.cumsum(size[row])
    most, out, i = max(MARKS // max(width, 1), 1), [], 0
    while i < len(row):
        # whole owners of few wedges; of one with more, steps that are added up
        end = int(np.searchsorted(wedges, (wedges[i - 1] if i else 0) + WEDGES, side="right"))
        last = min(owner[end] if end < len(row) else owner[-1] + 1, owner[i] + most)
        lo, hi = owner[i], max(last, owner[i] + 1)
        j = int(np.searchsorted(owner, hi))
        acc = np.zeros((hi - lo) * width, dtype=np.int64)
        while i < j:
            e = min(max(int(np.searchsorted(wedges, (wedges[i - 1] if i else 0) + WEDGES, side="right")), i + 1), j)
            k = size[row[i:e]]
            at = np.repeat(rows.ptr[row[i:e]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            acc += np.bincount(np.repeat((owner[i:e] - lo) * width, k) + rows.near[at], minlength=len(acc))
            i = e
        z = np.flatnonzero(acc)
        out.append((nodes[lo + z // width], rows.values[z % width], acc[z]))
    cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
    return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip("uvn", cols, strict=True)})


def shared_counts(arcs: DataFrame) -> DataFrame:
    """(u, v, n): of different arcs(u, x), how many x any two nodes share, a node with itself too; pairs without any are left out."""
    m, kind = _type(arcs, "u", "x")
    k = max(-(-m // PART_ENTRIES), min(4, _parts(m)))  # both sides are sent k times
    near = lambda key, value, *more: arcs.groupBy(F.col(key).cast(kind).alias("node"), *more).agg(F.collect_list(F.col(value).cast(kind)).alias("near"))
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asks = near("u", "x").select(every.alias("p"), _part("node", k).alias("s"), "node", "near")
    held = near("x", "u", _part(F.col("u").cast(kind), k).alias("p")).select("p", every.alias("s"), F.col("node").alias("held"), F.col("near").alias("held_near"))
    return asks.groupBy("p", "s").cogroup(held.groupBy("p", "s")).applyInArrow(_step_task, "u long, v long, n long")
