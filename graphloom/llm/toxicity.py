"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Units are words (lower case, outer punctuation cut off) and runs of single characters read as one
word, between boundary marks. Two units are compared by their common subsequences of three symbols
with at most GAP symbols left out at each step, each weighted by DECAY to the power of its length:
so an insult with letters spread out or strange ones put in keeps most of its kernel value. The
value is divided by the root of both units' sums of squared weights.

Training takes labelled texts, in which only some unit of a toxic text is toxic: each round the SVM
is fitted to the most toxic unit of each toxic text against the most toxic units of the others, then
the units are chosen anew. Landmarks are the most frequent chosen units of both sides. A linear SVM
on Nyström features is a weighted sum of landmark kernels, and as the kernel has explicit features,
that sum is one weight per feature: scoring a unit is a lookup per subsequence. A text's margin is
the largest of its units; a logistic fit turns it into a score.

Training rows: at most TOXIC + CLEAN labelled texts, chosen by the hash of their id. A text without
units scores as the least margin does. Defined results: null text is empty; every row is scored by
its own text; labels are taken at their maximum where an id repeats, null labels are ignored;
columns of docs named like the score that is added are replaced, other columns are passed by or
ignored; rows that repeat an id and a text train once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from graphloom.llm import textops as X

TOXIC, CLEAN = 2000, 3000
GAP, DECAY = 2, 0.8
LANDMARKS, ROUNDS = 200, 5
FLOOR = -3.0
#: Weight of the hinge losses of toxic units against the regulariser, and of the others in proportion.
COST, AGAINST = 1000.0, 16.0
#: Toxic texts that a unit of no clean text must be in to count as toxic from the start.
OFTEN = 4
#: Toxic units, most frequent first, of which spoilt variants are trained on too.
VARIED = 24
#: Units of each clean text that are trained against.
HARD = 4
#: Texts of either label that calibration on texts not trained on needs.
APART = 20
#: Labelled ids that are broadcast at most.
SHIPPED = 1_000_000
_SIZE = 64
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”„’…–—"


def _alphabet() -> np.ndarray:
    """Symbol by code point: 0 pads, 63 is a boundary, letters a-z and digits have their own, all others share 26, neighbours in an alphabet not the same one."""
    t = (37 + np.arange(0x110000) % 26).astype(np.int8)
    for i in range(26):
        t[ord("a") + i] = 1 + i
    for i in range(10):
        t[ord("0") + i] = 27 + i
    t[0], t[2] = 0, 63
    return t


_CODE = _alphabet()


def units(text: str) -> set[str]:
    low = text.lower()
    out = {w.strip(_EDGES) for w in set(low.split())}
    out |= {m.group().replace(" ", "").replace("\t", "") for m in _SPACED.finditer(low)}
    out.discard("")
    return out


class Features:
    """Weighted subsequences of many units at once: unit of, code of and weight of each."""

    def __init__(self, words: list[str]):
        text = "".join([f"\x02{w}\x02\0\0\0\0\0\0" for w in words]).replace("\x02\x02", "\x02") + "\0" * 8
        c = _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
        starts = np.flatnonzero((c[1:] != 0) & (c[:-1] == 0)) + 1
        self.starts = np.concatenate([[0], starts]) if len(c) and c[0] else starts
        self.n = len(words)
        self.c = c

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each way to leave symbols out: where subsequences start, their codes, and their weight."""
        c, m = self.c, len(self.c)
        for g1 in range(GAP + 1):
            for g2 in range(GAP + 1):
                i, j = 1 + g1, 2 + g1 + g2
                a, b, d = c[: m - j], c[i : m - j + i], c[j:]
                code = (a * _SIZE + b) * _SIZE + d
                code[(a == 0) | (b == 0) | (d == 0)] = 0
                yield code, DECAY ** (j + 1)

    def margins(self, theta: np.ndarray) -> np.ndarray:
        """Sum of feature weights over the root of the unit's own value."""
        m = len(self.c)
        total, own = np.zeros(m, dtype=np.float32), np.zeros(m, dtype=np.float32)
        for code, w in self.each():
            total[: len(code)] += np.float32(w) * theta[code]
            own[: len(code)] += np.float32(w * w) * (code > 0)
        s, o = np.add.reduceat(total, self.starts), np.add.reduceat(own, self.starts)
        return s / np.sqrt(np.maximum(o, 1e-6))

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, code and normalised weight of every feature."""
        of = np.cumsum(np.isin(np.arange(len(self.c)), self.starts)) - 1
        u, k, w = [], [], []
        for code, x in self.each():
            at = np.flatnonzero(code)
            u.append(of[at])
            k.append(code[at])
            w.append(np.full(len(at), x))
        u, k, w = np.concatenate(u), np.concatenate(k), np.concatenate(w)
        own = np.bincount(u, w * w, self.n)
        return u, k, w / np.sqrt(np.maximum(own[u], 1e-6))


def _svm(z: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps; c weighs the rows."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    reg = np.eye(z1.shape[1]) * 1.0
    reg[-1, -1] = 1e-6
    w = np.zeros(z1.shape[1])
    for _ in range(steps):
        on = y * (z1 @ w) < 1
        a = z1[on] * c[on, None]
        new = np.linalg.solve(reg + 2 * a.T @ z1[on], 2 * a.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """One weight per subsequence, an offset, and the logistic fit of a text's largest margin."""

    def __init__(self, theta: np.ndarray, bias: float, a: float, b: float):
        self.theta, self.bias, self.a, self.b = theta, bias, a, b

    def unit_margins(self, words: list[str]) -> np.ndarray:
        parts = [Features(words[lo : lo + 50_000]).margins(self.theta) for lo in range(0, len(words), 50_000)]
        return np.maximum(np.concatenate([np.zeros(0), *parts]) + self.bias, FLOOR)

    def scores(self, texts: list[str]) -> np.ndarray:
        number: dict[str, int] = {}
        own = [[number.setdefault(w, len(number)) for w in units(t)] for t in texts]
        m = self.unit_margins(list(number))
        top = np.array([m[x].max() if x else FLOOR for x in own])
        return 1 / (1 + np.exp(-np.clip(self.a * top + self.b, -30, 30)))


def variants(word: str) -> list[str]:
    """The word with a strange character put in at two places, and with all its letters apart."""
    if len(word) < 4:
        return []
    a, b = len(word) // 3, (2 * len(word)) // 3
    return [word[:a] + "x" + word[a:], word[:b] + "*" + word[b:], word[:a] + "." + word[a:b] + "_" + word[b:], ".".join(word)]


def _without_copies(bags: list[list[str]], labels: list[int]) -> tuple[list[list[str]], list[int]]:
    """Leave out texts of equal label whose units have the same four least hashes as an earlier one's: copies of a text are no further evidence."""
    seen: set = set()
    keep = []
    for i, (bag, label) in enumerate(zip(bags, labels, strict=True)):
        key = (label, *sorted(map(xxh64_intdigest, bag))[:4])
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return [bags[i] for i in keep], [labels[i] for i in keep]


def train(bags: list[list[str]], labels: list[int]) -> Model:
    """bags: the units of each text. Scores are calibrated on every fifth text by a model that has not seen it, if there are enough."""
    bags, labels = _without_copies(bags, labels)
    y = np.array(labels)
    model = _trained(bags, y)
    apart = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        apart[np.flatnonzero((y > 0) == label)[::5]] = True
    if (y[apart] > 0).sum() >= APART and (y[apart] < 1).sum() >= APART:
        other = _trained([x for x, a in zip(bags, apart, strict=True) if not a], y[~apart])
        seen = [bags[i] for i in np.flatnonzero(apart)]
        top = np.array([other.unit_margins(x).max() if x else FLOOR for x in seen])
        model.a, model.b = _logistic(top, (y[apart] > 0).astype(float))
    return model


def _trained(bags: list[list[str]], y: np.ndarray) -> Model:
    theta = np.zeros(_SIZE**3, dtype=np.float32)
    if not (y > 0).any() or not (y < 1).any():
        return Model(theta, 0.0, 0.0, 5.0 if (y > 0).any() else -5.0)
    pos, neg = Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        (pos if label else neg).update(bag)
    words = sorted({*pos, *neg})
    number = {w: i for i, w in enumerate(words)}
    own = [np.array([number[w] for w in bag], dtype=np.int64) for bag in bags]
    p, n = np.array([pos[w] for w in words]), np.array([neg[w] for w in words])
    margin = np.log((p + 0.05) / (y > 0).sum()) - np.log((n + 0.5) / (y < 1).sum()) + 1e-3 * np.minimum(p, 9)
    ratio = (y < 1).sum() / (y > 0).sum()
    telling = p * ratio > 3 * n  # three times as frequent in toxic texts, at least
    sure = (n == 0) & (p >= OFTEN) & (p * ratio >= 20)  # by chance clean texts would have had it
    bias = 0.0
    for r in range(ROUNDS):
        bad, good = Counter(), Counter()
        for x, label in zip(own, y, strict=True):
            if not len(x):
                continue
            if label:  # the most toxic unit, and others that no clean text has
                x = x[telling[x]]
                if len(x):
                    bad[int(x[np.argmax(margin[x])])] += 1
                    bad.update(x[sure[x] if r == 0 else sure[x] | (margin[x] > 0.5)].tolist())
            else:
                good.update(x[np.argsort(-margin[x])[:HARD]].tolist())
        if r == 0:  # a unit that one toxic text alone has proves nothing yet
            often = {u: k for u, k in bad.items() if p[u] >= 2 and n[u] == 0}
            bad = Counter(often or bad)
        for u in bad:
            good.pop(u, None) if bad[u] > good[u] else None
        rng = np.random.default_rng(r)
        plain = rng.permutation(np.flatnonzero(n > 0))[:3000]
        marks = [u for u, _ in bad.most_common(LANDMARKS // 2)]
        marks += [u for u, _ in sorted(good.items(), key=lambda x: (-margin[x[0]], x[0]))[: LANDMARKS // 2] if u not in marks]
        spoilt = [v for u, _ in bad.most_common(VARIED) for v in variants(words[u])]
        names = [words[u] for u in marks] + spoilt
        mu, mk, mw = Features(names).matrix()
        codes = np.unique(mk)
        dense = np.zeros((len(codes) + 1, len(names)), dtype=np.float32)  # the last row is of codes that no landmark has
        np.add.at(dense, (np.searchsorted(codes, mk), mu), mw)

        def kernel(us: list[str], codes=codes, dense=dense) -> np.ndarray:
            out = []
            for lo in range(0, len(us), 1000):
                f = Features(us[lo : lo + 1000])
                u, k, w = f.matrix()
                at = np.minimum(np.searchsorted(codes, k), len(codes) - 1)
                hit = codes[at] == k
                z = np.zeros((f.n, dense.shape[1]))
                np.add.at(z, u[hit], w[hit, None] * dense[at[hit]])
                out.append(z)
            return np.concatenate(out)

        val, vec = np.linalg.eigh(kernel(names) + 1e-3 * np.eye(len(names)))
        root = (vec / np.sqrt(np.maximum(val, 1e-6))) @ vec.T
        rows = np.array([*bad, *good, *(u for u in plain.tolist() if u not in bad and u not in good)])
        sign = np.where(np.arange(len(rows)) < len(bad), 1.0, -1.0)
        weight = np.array([*(1 + np.log(k) for k in bad.values()), *np.ones(len(rows) - len(bad))])
        weight[: len(bad)] *= COST / weight[: len(bad)].sum()
        weight[len(bad) :] *= AGAINST * COST / max(len(rows) - len(bad), 1)
        more = np.full(len(spoilt), 0.5 * COST / max(len(spoilt), 1))
        z = kernel([words[u] for u in rows] + spoilt) @ root
        w, bias = _svm(z, np.append(sign, np.ones(len(spoilt))), np.append(weight, more))
        theta = np.zeros(_SIZE**3, dtype=np.float32)
        theta[codes] = dense[:-1] @ (root @ w)
        margin = Model(theta, bias, 0, 0).unit_margins(words)
    top = np.array([margin[x].max() if len(x) else FLOOR for x in own])
    return Model(theta, bias, *_logistic(top, (y > 0).astype(float)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most TOXIC texts of label 1 and CLEAN of label 0."""
    X.small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(known) if known.count() <= SHIPPED else known, "id")
    texts = texts.withColumn("key", F.xxhash64("id", "t"))
    keys = texts.select("id", "key", "y").distinct()

    def some(y: int, n: int) -> DataFrame:
        return keys.where(F.col("y") == y).orderBy("key", "id").limit(n)

    chosen = F.broadcast(some(1, TOXIC).union(some(0, CLEAN)).select("id", "key"))  # TOXIC + CLEAN rows at most
    texts = texts.join(chosen, ["id", "key"]).groupBy("id", "key", "y").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(units(t or "")) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["y", "bag"])

    got = texts.orderBy("key", "id").select("y", "t").mapInArrow(run, "y int, bag array<string>").toArrow()
    return train(got.column("bag").to_pylist(), got.column("y").to_pylist())


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs' columns but the text, and the score in a column named out."""
    X.small_batches(docs.sparkSession)
    ship = docs.sparkSession.sparkContext.broadcast(model)  # 64**3 weights
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), out.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = X.as_bytes(b.column(b.num_columns - 1))
            for lo, hi in X.chunks(raw, 8 << 20):
                s = ship.value.scores([t.decode() for t in raw[lo:hi]])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], pa.array(s, pa.float64())], names=[*rest, out])

    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(out, T.DoubleType())])
    return docs.select(*rest, F.col(text_col).cast("string").alias(X.free_names(rest, "_text")[0])).mapInArrow(run, schema)
