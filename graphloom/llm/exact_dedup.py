"""Exact deduplication: rows meet by a 128-bit hash of their text, and bytes are compared where hashes are equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textops import free_names
from graphloom.plans.scratch import materialize

#: Bits of the filter that keeps texts without a copy out of the comparison: 512 buckets of 4 KB at most. Beyond some
#: ten million groups it lets more and more texts pass, which costs time and nothing else.
FILTER_BITS = 1 << 24
#: A group that holds more than one row in so many is joined by broadcast; there are fewer of them than this.
HEAVY = 1000


def same_but_for_spaces(text: Column) -> Column:
    r"""The text as equality sees it: null is empty, and each run of [\x20\x09-\x0D] is one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def leading_bits(digest: Column) -> Column:
    """The first 128 bits of a SHA-256."""
    return F.substring(digest, 1, 16)


def _seen(h: Column) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(FILTER_BITS)) + 1


def _may_repeat(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows whose h may be one of repeated(h), told by a bitmap of a fixed size."""
    at = repeated.select(_seen(F.col("h")).alias("x")).select(F.bitmap_bucket_number("x").alias("bucket"), F.bitmap_bit_position("x").alias("bit"))
    maps = at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    near = rows.withColumns({"bucket": F.bitmap_bucket_number(_seen(F.col("h"))), "bit": F.bitmap_bit_position(_seen(F.col("h")))})
    byte = F.conv(F.hex(F.expr("substring(bits, int(bit div 8) + 1, 1)")), 16, 10).cast("int")
    return near.join(F.broadcast(maps), "bucket").where((F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, int(bit % 8))"))) != 0).drop("bucket", "bit", "bits")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] = same_but_for_spaces, key: Callable[[Column], Column] = leading_bits) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Rows belong together when normal(text) is equal byte by byte. They meet by key, a hash of it; texts whose
    key occurs again are compared in full, and a key under which different texts met (a collision) is judged
    by the texts themselves. Only keys are shuffled for all rows, texts only where a key recurs, and equal
    texts are combined before the shuffle, so a group may hold any share of the rows.

    Exactly one row of a group is kept: of the least id, nulls last; of rows that repeat that id, one. A null
    text equals an empty one. A very long text is hashed like any other and shuffled at most once per task
    that holds it. Other columns, whatever their names, are not looked at. No rows give no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("t"))
    hashed = base.withColumn("sha", F.unhex(F.sha2("t", 256))).withColumn("h", key(F.col("sha")))
    keys = materialize(hashed.select(F.monotonically_increasing_id().alias("rid"), "id", "sha", "h"), "exact-keys")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    repeated = materialize(keys.groupBy("h").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1"), "exact-groups")

    texts = _may_repeat(hashed.select("h", "t"), repeated).groupBy("h", "t").agg(F.lit(1).alias("one"))
    collided = materialize(texts.groupBy("h").count().where("count > 1").select("h"), "exact-collided")
    total = keys.count()
    heavy = repeated.where(F.col("n") * HEAVY > total)
    light = repeated.where(F.col("n") * HEAVY <= total)
    found = keys.join(F.broadcast(heavy), "h").select(keys.columns + ["n", "first"])
    rest = keys.join(F.broadcast(heavy.select("h")), "h", "left_anti").join(light, "h", "left").select(keys.columns + ["n", "first"])
    judged = found.union(rest)
    if not collided.isEmpty():
        again = materialize(hashed.join(collided, "h", "left_semi").select(F.monotonically_increasing_id().alias("rid"), "id", "sha", "h", "t"), "exact-texts")
        groups = again.groupBy("h", "t").agg(F.count("*").alias("n"), first.alias("first"))
        judged = judged.join(collided, "h", "left_anti").select(keys.columns + ["n", "first"]).union(again.join(groups, ["h", "t"]).select(keys.columns + ["n", "first"]))
    alone = F.col("first").isNull()
    return judged.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, all columns as they were; of rows equal in id and text, one."""
    stay = exact_duplicates(docs, id_col, text_col).where("kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    (sha,) = free_names(docs.columns, "sha")
    rows = docs.withColumn(sha, F.unhex(F.sha2(same_but_for_spaces(F.col(text_col)), 256))).dropDuplicates([id_col, sha])
    return rows.join(stay, rows[id_col].eqNullSafe(stay["doc_id"]) & (rows[sha] == stay["sha"]), "left_semi").select(*[rows[c] for c in docs.columns])
