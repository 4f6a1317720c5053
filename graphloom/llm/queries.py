"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.repeats import removal_report

    return removal_report(_table(spark, sf_dir, "documents"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.chat import digests, format_conversations

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return digests(format_conversations(rows.union(tricky)))


def op1_additive_quantisation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.neighbours import nearest

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs, _table(spark, sf_dir, "labels").where(fold != 1))
    out = score(docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import KEEP, fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    out = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", "quality_score", "text_score", "metadata_score", (F.col("quality_score") >= KEEP).alias("kept"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 is dropped, 1 loses its text, 2 its ends of sentences, 3 comes twice, 4 is the user's. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    base = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return base.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.conversations import repair_report

    rows = _table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.resample import resample

    out = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, n=2, buckets=10000, least_words=20, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
