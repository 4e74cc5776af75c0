"""Preparing a training corpus: language, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next stage's
documents.  All stages but the last return the columns of ``documents``.  Nulls, empty texts, repeated rows and extra columns are
handled as the operators' docstrings say; a null or letterless text has no language and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fraudscope.llm import bpe, decontam, langid, simhash, suffix
from fraudscope.llm.common import stored
from fraudscope.llm.queries import table, tokenizer

#: Cosine below which a text is like no language at all.
MIN_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the folds outside the held-out one; texts without a language go."""
    prototypes = langid.train(docs.filter(langid.fold("doc_id", 4) != 2))
    return langid.reject(docs, prototypes, MIN_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays (3-word shingles, 2 bits)."""
    return simhash.deduplicate(docs, shingle=3, limit=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside 200-byte strings that also start elsewhere go."""
    return suffix.clean(docs, length=200)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with the digests of ids and decoded text."""
    return bpe.digests(bpe.encode_decode(docs, tokenizer("byte_bpe_50k.json")), with_ids=True)


STAGES = [
    ("language_id", language), ("simhash_dedup", near_copies), ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_leaks), ("bpe", tokens),
]

#: SQL cannot express fingerprints, prototypes or token ids; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
