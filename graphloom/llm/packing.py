"""Packing of token pieces into fixed-size sequences by fitted length patterns.

Each document becomes tokens plus an end token; only documents above the capacity are cut, so that
all pieces but the first are full. Full pieces are sequences of their own. For the others only the
histogram of lengths (at most capacity - 1 bins) reaches the driver: patterns of at most four lengths
are enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded
down; what the fit leaves over tells which further patterns are worth a round, and the rest is packed by
best fit, still on the histogram. The plan never has more sequences than best fit alone. Pieces then find their place from their rank within their length:
ranks come from counts per (task, length), so no length is gathered into one task.

Defined results: a null or empty text is a piece of the end token alone; every row is packed, also
rows that repeat an id or have none; no rows give no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textops as X
from graphloom.plans.scratch import materialize

CAPACITY, END = 1024, 2
#: Pieces of a pattern at most, rounds of patterns at most, what a sequence costs against a squared piece, and the shares of fitted counts that are tried.
FEW, ROUNDS, PRICE, SHARES = 4, 8, 0.5, (1.0, 0.95, 0.9, 0.8, 0.6, 0.4, 0.2)
#: Pieces of text whose ids a task keeps, and their greatest length.
KNOWN, LONG = 1 << 19, 64
#: New words that go through one call.
JOINED = 4096

Pattern = tuple[tuple[int, ...], int]


def tokenizer_path() -> str:
    """The public byte-level vocabulary as tokenizers JSON."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a byte-level tokenizers file, as its plain call gives them without special tokens.

    The file's word pattern always parts a text before a single space between two characters that are
    no white space, on both sides of a single line end between two such, and between a letter and a
    full stop, comma or the like. So a text whose spaces all
    stand between two characters of _SOLID is cut at them, and each different word is encoded once,
    with its space, and kept as the bytes of its ids; a mark after a letter at its end, and single line
    ends inside between two characters of _SOLID with what follows them, have ids of their own. New words of letters alone are one word of the pattern and go straight to the file's BPE model;
    others go through the plain call together, joined by spaces: as only the first token of each begins
    with a space, the ids are dealt out again. Other texts are cut by _CUT, which finds
    such spaces one by one, and their pieces go through the plain call. Strings of added tokens hold
    none of these cuts.
    """

    _LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    _SOLID = re.compile(rf"[!-~{_LETTERS}](?:.*[!-~{_LETTERS}])?", re.DOTALL)
    _CUT = re.compile(rf"(?<=[!-~{_LETTERS}])(?= [!-~{_LETTERS}])|(?<=[{_LETTERS}])(?=[.,;:!?)])")
    _WORD = re.compile(rf"[{_LETTERS}]+")
    _MARKED = re.compile(rf".*[{_LETTERS}][.,;:!?)]", re.DOTALL)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.call = Tokenizer.from_file(path)
        self._model = self.call.model
        spelt = self.call.pre_tokenizer.pre_tokenize_str
        space = spelt(" a")[0][0][:-1]
        letters = [c for c in map(chr, range(0x250)) if self._WORD.fullmatch(c)]
        self.table = {ord(c): spelt(c)[0][0] for c in letters} | {32: f" {space}"}
        if self._of_letters(["".join(letters)]) != self._plain([" " + "".join(letters)]):
            raise ValueError("the file's tokenizer is no byte-level BPE that takes letters as one word")
        vocabulary = self.call.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        #: By word, with the space before it; by piece, as it stands.
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        marks = list(".,;:!?)")
        self.marks = dict(zip(marks, self._plain(marks), strict=True))
        (self.line,) = self._plain(["\n"])

    def _plain(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.call.encode_batch_fast(pieces, add_special_tokens=False)]

    def _of_letters(self, words: list[str]) -> list[bytes]:
        """The same of words of _LETTERS alone."""
        spell = self._model.tokenize
        return [array("I", [t.id for t in spell(x)]).tobytes() for x in (" " + " ".join(words)).translate(self.table).split(" ")[1:]] if words else []

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it."""
        out = []
        for lo in range(0, len(words), JOINED):
            some = words[lo : lo + JOINED]
            ids = np.array(self.call.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(some):  # the model joins what begins with a space to what stands before it
                out += self._plain([" " + x for x in some])
                continue
            raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
            out += [raw[x:y] for x, y in zip((4 * at).tolist(), ends, strict=True)]
        return out

    def _learn(self, new: set[str]) -> list[str]:
        """Solid words become known, and those of LONG among them are returned; others do not, as no space beside them is sure to be a cut."""
        letters, stems, other = [], {}, []
        for x in new:
            if self._WORD.fullmatch(x):
                letters.append(x)
            elif x and x[-1] in self.marks and self._WORD.fullmatch(y := x[:-1]):
                stems[x] = y
            else:
                other.append(x)
        solid = {x for x in other if self._SOLID.fullmatch(x)}
        lines = {x: x.split("\n") for x in solid if "\n" in x}
        lines = {x: y for x, y in lines.items() if all(map(self._SOLID.fullmatch, y))}
        mixed = solid.difference(lines).union(y[0] for y in lines.values()).difference(self.words)
        ends = {x: x[:-1] for x in mixed if x[-1] in self.marks and self._MARKED.fullmatch(x)}
        mixed = list(mixed.difference(ends).union(ends.values()).difference(self.words, letters))
        letters += set(stems.values()).difference(self.words, letters, mixed)
        self.words.update(zip(letters, self._of_letters(letters), strict=True))
        self.words.update(zip(mixed, self._joined(mixed), strict=True))
        stems |= ends
        self.words.update({x: self.words[y] + self.marks[x[-1]] for x, y in stems.items()})
        later = list({z for y in lines.values() for z in y[1:]})
        ids = dict(zip(later, self._pieces(later), strict=True))
        self.words.update({x: self.line.join([self.words[y[0]], *map(ids.__getitem__, y[1:])]) for x, y in lines.items()})
        return [x for x in chain(letters, mixed, stems, lines) if len(x) > LONG]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        split = [self._CUT.split(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        self.known.update(zip(new, self._plain(new), strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, x)) for x in split]
        for x in new:
            if len(x) > LONG:
                del self.known[x]
        return out

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, and END."""
        if len(self.words) + len(self.known) > KNOWN:
            self.words.clear()
            self.known.clear()
        split = [t.split(" ") for t in texts]
        heads = [x.pop(0) for x in split]  # no space stands before the first word
        new = set(chain.from_iterable(split)).difference(self.words)
        long = self._learn(new)
        get, tails = self.words.__getitem__, []
        for i, x in enumerate(split):
            try:
                tails.append(b"".join(map(get, x)))
                whole = x and not self._SOLID.fullmatch(heads[i])
            except KeyError:
                tails.append(b"")
                whole = True
            if whole:
                heads[i], tails[i] = texts[i], b""
        for x in long:
            self.words.pop(x, None)
        end = np.array([END], dtype="<u4").tobytes()
        return [np.frombuffer(b"".join((x, y, end)), dtype="<u4") for x, y in zip(self._pieces(heads), tails, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


_ENCODERS: dict[str, Encoder] = X.keep({})


def encoder(path: str) -> Encoder:
    """One per worker process, whose tasks share what it knows until a task of textops.fresh starts there."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth[, ids]): pieces, numbered within their task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, counts = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            texts = X.as_bytes(b.column(1))
            for lo, hi in X.chunks(texts):
                at, rows = [], []
                for i, ids in enumerate(enc.many([t.decode() for t in texts[lo:hi]]), lo):
                    for p, (s, n) in enumerate(cuts(len(ids), capacity)):
                        raw = ids[s : s + n].tobytes()
                        at.append(i)
                        rows.append((p, s, n, zlib.crc32(raw), part, int(counts[n]), *([ids[s : s + n].tolist()] if with_ids else [])))
                        counts[n] += 1
                cols = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = ["piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names=["id", *names[: len(cols)]])

    X.small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = dict(base.dtypes)["id"]
    return base.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids)


def _priced(worth: np.ndarray, present: np.ndarray, capacity: int) -> set[tuple[int, ...]]:
    """For each present length, the pattern of at most FEW pieces with it whose worth, summed over its pieces, is greatest; worth[l] is that of a piece of length l."""
    value = np.maximum(worth[present], 0.0)
    best, by = [np.zeros(capacity + 1)], []
    for _ in range(FEW - 1):
        top, pick = best[-1].copy(), np.zeros(capacity + 1, dtype=np.int64)
        for l, v in zip(present.tolist(), value.tolist(), strict=True):
            if v > 0:
                other = best[-1][: capacity + 1 - l] + v
                at = np.flatnonzero(other > top[l:]) + l
                top[at], pick[at] = other[at - l], l
        best.append(top)
        by.append(pick)
    out = set()
    for l in present.tolist():
        p, room = [l], capacity - l
        for pick in reversed(by):
            if pick[room]:
                p.append(int(pick[room]))
                room -= p[-1]
        out.add(tuple(sorted(p, reverse=True)))
    return out


def fit_counts(patterns: list[tuple[int, ...]], hist: np.ndarray, start: np.ndarray, price: float = PRICE, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|²/2 + price * sum(x), A[l, j] being how often pattern j has length l, by accelerated projected gradients.

    At the least, the residual over the price says what one more piece of each length costs in sequences.
    """
    at = np.array([x for p in patterns for x in p])
    of = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    made = lambda x: np.bincount(at, x[of], len(hist))
    pull = lambda r: np.bincount(of, r[at], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):
        v = pull(made(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    x, y, t = start, start, 1.0
    for _ in range(steps):
        new = np.maximum(y - (pull(made(y) - hist) + price) / (1.05 * norm), 0.0)
        if float((new - x) @ (y - new)) > 0:  # the momentum points uphill
            t = 1.0
        up = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / up * (new - x), up
    return x


def _best_fit(hist: np.ndarray, capacity: int) -> Iterator[Pattern]:
    """Largest first, each followed by the largest that still fits; equal sequences are made at once."""
    while len(left := np.flatnonzero(hist)):
        p, room, take = [], capacity, {}
        while room and len(fit := left[left <= room]):
            x = next((int(v) for v in fit[::-1] if hist[v] > take.get(int(v), 0)), 0)
            if not x:
                break
            p.append(x)
            take[x] = take.get(x, 0) + 1
            room -= x
        n = min(int(hist[x]) // k for x, k in take.items())
        for x, k in take.items():
            hist[x] -= n * k
        yield tuple(p), n


def least_sequences(hist: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound: pieces above half a sequence stand alone, and what small ones they can't take in needs more; the greatest over all bounds of small."""
    at = np.arange(len(hist))
    out = -(-int((hist * at).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        big, mid = (at > capacity - k), (at <= capacity - k) & (at > capacity // 2)
        small = (at >= k) & (at <= capacity // 2)
        room = int(hist[mid].sum()) * capacity - int((hist * at)[mid].sum())
        out = max(out, int(hist[big | mid].sum()) + max(0, -(-(int((hist * at)[small].sum()) - room) // capacity)))
    return out


def plan_patterns(hist: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """(lengths, repeats) that use up the histogram, hist[l] being how many pieces have length l < capacity.

    Patterns of at most FEW pieces come first from a best fit of the histogram and then, round by round, from
    all lengths by what the last fit's residual says a piece is worth. Rounding down leaves pieces to best fit;
    where that makes more sequences than best fit of all does, a smaller share of the counts is taken, so that
    more small pieces are left for the large ones.
    """
    hist = hist.astype(np.int64)
    alone, present = list(_best_fit(hist.copy(), capacity)), np.flatnonzero(hist)
    most, floor = sum(n for _, n in alone), least_sequences(hist, capacity)
    counts: dict[tuple[int, ...], float] = {}
    for p, n in alone:
        if len(p) <= FEW:
            p = tuple(sorted(p, reverse=True))
            counts[p] = counts.get(p, 0.0) + n
    best: list[Pattern] | None = None
    for _ in range(ROUNDS):
        patterns = list(counts)
        if not patterns:
            break
        x = fit_counts(patterns, hist, np.array(list(counts.values())))
        counts = dict(zip(patterns, x.tolist(), strict=True))
        for share in SHARES:
            left, out = hist.copy(), []
            for j in np.argsort(-x, kind="stable"):
                need = {v: patterns[j].count(v) for v in patterns[j]}
                n = min(int(share * x[j] + 1e-6), *(int(left[v]) // k for v, k in need.items()))
                if n > 0:
                    out.append((patterns[j], n))
                    for v, k in need.items():
                        left[v] -= n * k
            out += _best_fit(left, capacity)
            used = sum(n for _, n in out)
            if used <= most:
                if best is None or used < most:
                    best, most = out, used
                break
        if best is not None and most == floor:
            break
        made = np.zeros(len(hist))
        for p, v in counts.items():
            for l in p:
                made[l] += v
        fresh = _priced((hist - made) / PRICE, present, capacity) - counts.keys()
        if not fresh:
            break
        counts = {p: v for p, v in counts.items() if v > 0} | dict.fromkeys(fresh, 0.0)
    return best if best is not None else alone


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenize(docs, id_col, text_col, path or tokenizer_path(), capacity), "pieces")
    short = pieces.where(F.col("length") < capacity)
    per = materialize(short.groupBy("part", "length").agg(F.count("*").alias("k")), "lengths")
    hist = np.zeros(capacity, dtype=np.int64)
    for r in per.groupBy("length").agg(F.sum("k").alias("k")).collect():  # one row per length below capacity
        hist[r["length"]] = r["k"]
    used, rows, seq = np.zeros(capacity, dtype=np.int64), [], 0
    for p, n in plan_patterns(hist, capacity):
        offset, nth = 0, {}
        for x in p:
            rows.append((x, used[x] + n * nth.get(x, 0), seq, offset))
            nth[x] = nth.get(x, 0) + 1
            offset += x
        for x, k in nth.items():
            used[x] += n * k
        seq += n
    plan = np.array(rows, dtype=np.int64).reshape(-1, 4)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    # a row per slot of a pattern: best fit uses a length up with each pattern it makes, and a round adds at most one of FEW pieces for each length
    if plan.nbytes > 32 * capacity * (2 * capacity + FEW * ROUNDS):
        raise ValueError(f"a plan of {plan.nbytes} bytes is too large to broadcast")
    ship = docs.sparkSession.sparkContext.broadcast(plan)
    before = F.sum("k").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = per.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = short.join(ranks, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = ship.value
        lo = np.searchsorted(plan[:, 0], np.arange(capacity + 1))
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            slot = np.empty(len(length), dtype=np.int64)
            for x in np.unique(length):
                of = np.flatnonzero(length == x)
                slot[of] = lo[x] + np.searchsorted(plan[lo[x] : lo[x + 1], 1], rank[of], "right") - 1
            cols = [*b.columns[:5], pa.array(plan[slot, 2] + rank - plan[slot, 1]), pa.array(plan[slot, 3])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["id"]
    placed = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select(
        "id", "piece", "start", "length", "ids_crc32", (-1 - F.shiftleft(F.col("part").cast("long"), 36) - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.union(full).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids): the packed sequences themselves; ids must name documents. At most capacity tokens meet in a group."""
    tokens = tokenize(docs, id_col, text_col, path or tokenizer_path(), capacity, with_ids=True).select(F.col("id").alias(id_col), "piece", "ids")
    parts = packed.join(tokens, [id_col, "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", id_col))).alias("s"))
    return parts.select("sequence_id", F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"), F.transform("s", lambda x: x[id_col]).alias("doc_ids"))
