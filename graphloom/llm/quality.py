"""Quality by co-training on two views: what the text holds, and the page's metadata.

The text view is style measured on the whole text (shares of kinds of characters, repeated words and
lines, word lengths); the metadata view is language, source and declared length, and never reads the
text. One logistic classifier per view starts from the labelled rows; in each round a view hands the
other the unlabelled rows it is most sure of, as long as such sureness has proved right on labelled
rows kept apart for that. Both are then calibrated and combined by a logistic fit on further rows
kept apart, so a view that says nothing gets no weight.

Training rows: at most LABELLED labelled and POOL unlabelled rows, chosen by hash of id and text.
Defined results: null text is empty, null metadata are values of their own; each row is scored by
its own content; an id labelled more than once counts by its least label; rows that repeat an id and
a text train once; without labels of both kinds (or without rows) all score 0.5 and stay; columns of
docs named like those that score adds are replaced, all others are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from graphloom.llm import textops as X

LABELLED, POOL = 8000, 8000
ROUNDS, SURE, PROVED, GIVEN = 5, 0.95, 0.95, 400
#: Score from which a document stays.
KEEP = 0.5
_SOURCES, _LANGS = 32, 8

_KIND = np.full(256, 6, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 sentence marks, 6 other marks, 7 beyond ASCII
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 0, 1, 2
_KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 3, 4, 7
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
_MARKS = b"*#$%&!|@/=<>{}[]_~^+\\"
TEXT_FEATURES = 10 + len(_MARKS) + 10
_LENGTHS = 24
META_FEATURES = _SOURCES + _LANGS + _LENGTHS + 2


def text_view(text: bytes) -> list[float]:
    n = max(len(text), 1)
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=8)
    words = text.split()
    w = max(len(words), 1)
    low = [x.lower().strip(b".,;:?!") for x in words]
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(low)) / w
    ends = sum(x[-1] in b".,;:?" for x in words) / w
    odd = sum(x[-1] in _MARKS or x[0] in _MARKS for x in words) / w
    capitals = sum(x.isupper() and len(x) > 1 for x in words) / w
    chars = sum(map(len, words)) / w
    pairs = len(set(zip(low, low[1:], strict=False))) / max(w - 1, 1)
    return [
        *(kinds / n).tolist(),
        np.log1p(w),
        chars,
        *(text.count(bytes([m])) / n for m in _MARKS),
        distinct,
        pairs,
        np.log1p(w) * (1 - pairs),
        len({x.strip() for x in lines}) / max(len(lines), 1),
        ends,
        odd,
        capitals,
        float(w < 5),
        float(w < 20),
        kinds[4] / w,
    ]


def meta_view(lang: str | None, source: str | None, declared: int | None) -> list[float]:
    out = [0.0] * META_FEATURES
    out[xxh32_intdigest(f"s{source}") % _SOURCES] = 1.0
    out[_SOURCES + xxh32_intdigest(f"l{lang}") % _LANGS] = 1.0
    n = max(declared or 0, 0)
    out[_SOURCES + _LANGS + min(n.bit_length(), _LENGTHS - 1)] = 1.0
    out[-2:] = [np.log1p(n), float(declared is None)]
    return out


class Logistic:
    """Ridge logistic regression on standardised inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])
        c = np.ones(len(x)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        reg = np.full(z.shape[1], ridge)
        reg[-1] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (c * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(reg), z.T @ (c * (p - y)) + reg * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Model:
    """exchanged: pseudo-labels that the text view gave the other, and those that it got, by round."""

    def __init__(self, text: Logistic, meta: Logistic, own: list[tuple[float, float]], both: Logistic, exchanged: list[tuple[int, int]]):
        self.text, self.meta, self.own, self.both, self.exchanged = text, meta, own, both, exchanged

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score, calibrated text score, calibrated metadata score."""
        v = np.stack([self.text.logit(a) * self.own[0][0] + self.own[0][1], self.meta.logit(b) * self.own[1][0] + self.own[1][1]], axis=1)
        return _sigmoid(self.both.logit(v)), _sigmoid(v[:, 0]), _sigmoid(v[:, 1])


def _calibrated(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    f = Logistic(v[:, None], y, ridge=1e-2)
    return float(f.w[0] / f.scale[0]), float(f.w[1] - f.w[0] * f.mean[0] / f.scale[0])


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> Model | None:
    """views, pool: text and metadata rows, labelled and not."""
    if len(y) < 8 or y.min() == y.max():
        return None
    turn = np.arange(len(y)) % 4  # rows are in hash order
    proof_rows, last_rows = turn == 0, turn == 3 if (turn == 3).sum() >= 100 else np.isin(turn, (0, 3))
    train = ~(proof_rows | last_rows)
    if any(y[rows].min() == y[rows].max() for rows in (proof_rows, last_rows, train)):
        train = proof_rows = last_rows = np.ones(len(y), dtype=bool)
    extra: list[list[tuple[int, float]]] = [[], []]  # what each view was told of the pool
    told: list[set[int]] = [set(), set()]

    def fitted(k: int) -> Logistic:
        at = [i for i, _ in extra[k]]
        x = np.vstack([views[k][train], pool[k][at]]) if at else views[k][train]
        return Logistic(x, np.concatenate([y[train], [v for _, v in extra[k]]]), np.concatenate([np.ones(int(train.sum())), np.full(len(at), 0.5)]))

    models, exchanged = [fitted(0), fitted(1)], []
    for _ in range(ROUNDS):
        before = len(extra[0]), len(extra[1])
        for k in (0, 1):
            if not len(pool[k]):
                continue
            p, seen = _sigmoid(models[k].logit(pool[k])), _sigmoid(models[k].logit(views[k][proof_rows]))
            for label, sure, sure_seen in ((1.0, p, seen), (0.0, 1 - p, 1 - seen)):
                proof = y[proof_rows][sure_seen >= SURE] == label
                if len(proof) < 10 or proof.mean() < PROVED:
                    continue
                best = [int(i) for i in np.argsort(-sure, kind="stable")[: GIVEN * 2] if sure[i] >= SURE and int(i) not in told[1 - k]][: GIVEN]
                told[1 - k].update(best)
                extra[1 - k] += [(i, label) for i in best]
        exchanged.append((len(extra[1]) - before[1], len(extra[0]) - before[0]))
        if exchanged[-1] == (0, 0):
            break
        models = [fitted(0), fitted(1)]
    own = [_calibrated(m.logit(v[last_rows]), y[last_rows]) for m, v in zip(models, views, strict=True)]
    both = np.stack([m.logit(v[last_rows]) * a + b for m, v, (a, b) in zip(models, views, own, strict=True)], axis=1)
    return Model(models[0], models[1], own, Logistic(both, y[last_rows], ridge=1e-1), exchanged)


def _columns(docs: DataFrame, names: tuple[str, str, str, str]) -> list:
    kinds, have = ("string", "string", "long", "string"), set(docs.columns)
    free = X.free_names(docs.columns, "_lang", "_source", "_declared", "_text")
    return [(F.col(n) if n in have else F.lit(None)).cast(k).alias(f) for n, k, f in zip(names, kinds, free, strict=True)]


def _views(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    lang, source, declared = (b.column(at + i).to_pylist() for i in range(3))
    texts = X.as_bytes(b.column(at + 3))
    a = np.array([text_view(t) for t in texts], dtype=np.float64).reshape(-1, TEXT_FEATURES)
    return a, np.array([meta_view(*x) for x in zip(lang, source, declared, strict=True)], dtype=np.float64).reshape(-1, META_FEATURES)


NAMES = ("lang", "source", "n_chars", "text")
SCORES = ("quality_score", "text_score", "metadata_score")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", names: tuple[str, str, str, str] = NAMES) -> Model | None:
    X.small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    views = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *(c.alias(f"v{i}") for i, c in enumerate(_columns(docs, names))))
    views = views.withColumn("key", F.xxhash64("id", "v3"))
    keys = views.select("id", "key").distinct()
    some = keys.join(known, "id").orderBy("key", "id").limit(LABELLED)
    other = keys.join(known, "id", "left_anti").orderBy("key", "id").limit(POOL).select("id", "key", F.lit(None).cast("int").alias("y"))
    chosen = F.broadcast(some.select("id", "key", "y").union(other))  # LABELLED + POOL rows at most
    mine = views.join(chosen, ["id", "key"]).groupBy("id", "key", "y").agg(*(F.min(f"v{i}").alias(f"v{i}") for i in range(3)), F.first("v3").alias("v3"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, m = _views(b, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(a), pa.list_(pa.float64())), pa.array(list(m), pa.list_(pa.float64()))], names=["key", "y", "a", "m"])

    got = mine.select("key", "y", "v0", "v1", "v2", "v3").mapInArrow(X.fresh(run), "key long, y int, a array<double>, m array<double>").toArrow()
    known = ~np.asarray(got.column("y").is_null()).astype(bool)
    y, keys_ = np.asarray(got.column("y").fill_null(0)).astype(np.float64), np.asarray(got.column("key"))
    a, m = (np.asarray(got.column(c).combine_chunks().flatten()).reshape(len(y), n) for c, n in (("a", TEXT_FEATURES), ("m", META_FEATURES)))
    turn = np.lexsort((*a.T[::-1], keys_))
    lab, pool = turn[known[turn]], turn[~known[turn]]
    return co_train((a[lab], m[lab]), y[lab], (a[pool], m[pool]))


def score(docs: DataFrame, model: Model | None, names: tuple[str, str, str, str] = NAMES, out: tuple[str, str, str] = SCORES) -> DataFrame:
    """docs with the combined, the text's and the metadata's score in columns named out."""
    X.small_batches(docs.sparkSession)
    ship = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    extra = _columns(docs, names)
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in out}]
    width, out_names = len(kept), [*kept, *out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                s = ship.value.scores(*_views(part, width)) if ship.value else [np.full(part.num_rows, 0.5)] * 3
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *(pa.array(v) for v in s)], names=out_names)

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in out)])
    return docs.select(*kept, *extra).mapInArrow(X.fresh(run), schema)
