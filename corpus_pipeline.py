"""Corpus pipeline: documents → quality rules → near duplicates → repeated passages → secrets → packing.

Each stage works on all that its predecessor kept and, but for the last, returns the columns of
``documents``; what one stage writes is read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import near_dup, packing, quality, secrets, suffix_dedup
from reelspark.llm.common import bounded_batches, read_table, shared_table
from reelspark.llm.queries import tokenizer_path


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` set anew after the text has changed; same columns."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    bounded_batches(spark)
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    return near_dup.keep_one(docs, words=5, share=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand in the corpus more than once go."""
    bounded_batches(spark)
    return _sized(suffix_dedup.remove_repeats(docs, words=51))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked."""
    return _sized(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1,024 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("repeats", repeated_passages),
          ("secrets", secret_scans), ("packing", pack)]

#: No SQL: the compression ratios and token ids have none; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
