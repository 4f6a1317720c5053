"""Importance resampling: brute force, chunks of long texts, awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import resample

SHAPE = "doc_id long, text string, uid long, score double, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], SHAPE)


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def features(t, n):
    w = words(t)
    return [zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=25, n=2, buckets=10000, least=20, seed=7):
    s, t = (Counter(f % buckets for _, x in rows for f in features(x, n)) for rows in (docs, target))
    alls, allt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets)))) for b in set(s)}
    out = []
    for i, x in docs:
        f = features(x, n)
        weight = sum(gain[b % buckets] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def rows_of(got):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got.collect()), key=repr)


def prose(rng, k, a, b):
    return " ".join(f"W{x}" if x % 5 else f"é{x}-" for x in rng.integers(a, b, k))


@pytest.mark.parametrize(("n", "chunk"), [(2, 1 << 20), (2, 300), (3, 64), (1, 50)])
def test_against_brute_force_whatever_the_chunks(spark, n, chunk):
    rng = np.random.default_rng(12)
    docs = [(i, prose(rng, int(rng.integers(1, 90)), 0, 300)) for i in range(150)] + [(500, prose(rng, 4000, 0, 900)), (501, "x" * 5000), (502, "a " + "y" * 3000 + " b c"), (503, " - " * 900)]
    docs += [(900, None), (901, ""), (902, "one"), (903, "..."), (904, "tail " * 30 + " " * 500), (None, prose(rng, 40, 0, 300))]
    target = [(i, prose(rng, 30, 100, 160)) for i in range(10)] + [(99, None)]
    got = resample.resample(frame(spark, docs), frame(spark, target), n=n, chunk=chunk)
    assert rows_of(got) == brute(docs, target, n=n)


def test_ties_repeats_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    same = prose(rng, 30, 0, 50)
    docs = [(i, same) for i in range(40)] + [(3, same), (3, same), (3, prose(rng, 25, 0, 50))]
    assert rows_of(resample.resample(frame(spark, docs), frame(spark, [(1, same)]))) == brute(docs, [(1, same)])
    none = frame(spark, docs).limit(0)
    assert resample.resample(none, frame(spark, docs)).count() == 0
    assert rows_of(resample.resample(frame(spark, docs), none)) == brute(docs, [])
    stay = resample.drawn_documents(frame(spark, docs), resample.resample(frame(spark, docs), none))
    assert stay.columns == ["doc_id", "text", "uid", "score", "rank"] and 0 < stay.count() < len(docs)


def test_draw_moves_towards_the_target(spark):
    rng = np.random.default_rng(9)
    docs = [(i, prose(rng, 60, 0, 200) if i % 10 else prose(rng, 60, 1000, 1100)) for i in range(600)]
    got = resample.resample(frame(spark, docs), frame(spark, [(i, prose(rng, 60, 1000, 1100)) for i in range(20)]), percent=10)
    drawn = [r.doc_id for r in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 60 and sum(i % 10 == 0 for i in drawn) >= 18  # three times their share of the documents


def test_chunks_own_each_run_once():
    rng = np.random.default_rng(3)
    for size in (1, 7, 40, 1000):
        for n in (1, 2, 3, 4):
            text = resample.spaced(prose(rng, 120, 0, 90).encode() + b" " * int(rng.integers(0, 60)))
            parts = [f for body, carried in resample.cut(text, n, size) for f in resample.runs(body.split(), carried, n)]
            assert sorted(parts) == sorted(resample.runs(text.split(), 0, n))
