"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination and byte-level BPE over documents.

Each stage is a function (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartosea.llm import bpe, decontaminate, near_dedup, quality, substring_dedup
from cartosea.llm.common import stage, tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and blank texts go (they have no words); equal rows stay or
    go together; an empty table stays empty."""
    tune(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), that of the smallest id (a null
    one comes last). Of equal rows one stays; rows without words are no duplicates and all stay."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words that stand anywhere else; n_chars follows the text. Documents of which
    nothing is left stay with an empty text, null texts stay null, and so do rows that equal each other, without the
    words that they share."""
    return substring_dedup.dedup_substrings(docs).selectExpr(*[f"cast(length(text) as bigint) as {c}" if c == "n_chars" else c for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak nothing; equal rows stay or go together; null
    and empty items are found nowhere."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to, for each row. A null or
    empty text has no ids; a null doc_id stays null; equal rows are rows of their own."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", leaks),
    ("bpe", encode),
]

#: SQL can't express MinHash components, edit distance in texts or BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
