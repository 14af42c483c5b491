"""Corpus pipeline: documents -> packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``, so a stage never recomputes the ones
before it and a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphframe.llm import decontaminate, langid, neardup, packing, suffixdedup

# Repeated passages of over 50 words.
REPEAT_WORDS = 51


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts with letters and a posterior of 0.5 or more."""
    return langid.keep_accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of every group of near-duplicates (shingles of
    5 words, similarity 0.8)."""
    return neardup.keep_one(docs, width=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``REPEAT_WORDS`` words or more that stand twice or more."""
    return suffixdedup.remove_passages(docs, words=REPEAT_WORDS, anchor=REPEAT_WORDS // 4)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", in_known_language),
    ("minhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

# Several stages (posteriors, suffix matches, greedy packing) have no SQL form; the tests
# hold the pipeline against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    from glyphframe.session import shared_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
