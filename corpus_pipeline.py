"""Corpus preparation: quality, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, extra ones included, whatever their names. A stage judges every document that its
predecessor kept. Without rows every stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, idfilter, near_dedup, packing, quality, secrets
from graphloom.llm.textops import free_names
from graphloom.plans.scratch import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the combined quality score rejects go. Labels teach it what is bad.

    Each row is judged by its own text and metadata, so repeated rows and null ids share no fate but
    by content; a null or empty text is judged as an empty one; without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = free_names(docs.columns, *quality.SCORES)
    scored = quality.score(docs, quality.fit(docs, labels), out=tuple(names))
    return scored.where(F.col(names[0]) >= quality.KEEP).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id; of rows that repeat an id, one.

    Texts that are null or have no words are like no other and stay, as do all rows with a null id.
    """
    judged = materialize(near_dedup.near_duplicates(docs, shingle=5, percent=80), "judged")
    gone = materialize(judged.where("NOT kept").select("doc_id").distinct(), "gone")
    may, safe = idfilter.split_by(docs, idfilter.bloom(gone, "doc_id"), "doc_id")  # only the former's texts are shuffled
    stay = safe.union(may.join(gone, "doc_id", "left_anti").select(*docs.columns))
    again = judged.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return stay
    return stay.join(again, "doc_id", "left_anti").union(stay.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of decontaminate.SPAN words of a benchmark item go.

    Items with fewer words are too common to condemn a document and are left out. Null and empty
    texts hold nothing and stay; an empty benchmark condemns none.
    """
    (out,) = free_names(docs.columns, "contamination")
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out, least_words=decontaminate.SPAN)
    return found.where(F.size(F.col(out)["hit_words"]) == 0).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are masked where they stand, and n_chars follows the text; no row goes."""
    (before,) = free_names(docs.columns, "text_before")
    clean = secrets.redact(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its place in a sequence of packing.CAPACITY tokens; a null or empty text is an end token."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]
#: Learnt and token-based stages can't be put in SQL. Tests hold near-dedup, decontamination and packing against
#: brute-force versions, and quality and secrets against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
