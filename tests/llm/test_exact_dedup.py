"""Exact deduplication: brute force, forced collisions, hot groups and awkward rows."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup

SHAPE = "doc_id long, text string, sha string, h long, n long, kept string"  # extra columns with names that clash


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "no") for r in rows], SHAPE)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[normal(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def held(spark, rows, **how):
    got = exact_dedup.exact_duplicates(frame(spark, rows), **how).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted({hashlib.sha256(normal(t).encode()).hexdigest() for _, t in rows})  # one of each text
    return got


def test_groups_nulls_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(13)
    rows = [(int(i), f"text {rng.integers(0, 60)}" + str(rng.choice(["", " ", "\n\t", " "])) + "end") for i in rng.permutation(400)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "\t\r\n"), (1004, "été \U0001f600"), (1005, "été \U0001f600"), (1006, "A"), (1007, "a")]
    rows += [(None, "only null ids"), (None, "only null ids"), (None, "null and one"), (2000, "null and one"), (7, "same row"), (7, "same row"), (8, "same row")]
    rows += [(3000, "long " * 200000), (3001, "long  " * 200000), (3002, "long " * 199999)]
    held(spark, rows)


def test_one_text_of_a_third_of_all_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    held(spark, rows)


def test_collisions_are_told_apart_by_bytes(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(900, None), (901, ""), (None, "text 3")]
    held(spark, rows, key=lambda sha: F.substring(sha, 1, 1).cast("binary"))  # some keys collide
    held(spark, rows, key=lambda sha: F.unhex(F.lit("00")))  # all do


def test_empty_table_and_rows_that_stay(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [(1, "a")]).limit(0)).count() == 0
    rows = [(1, "a b"), (2, "a  b"), (2, "a  b"), (3, None), (None, ""), (None, "c"), (None, "c")]
    out = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "sha", "h", "n", "kept"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == [(1, "a b"), (3, None), (None, "c")]


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.exact_duplicates(frame(spark, [(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups"))
