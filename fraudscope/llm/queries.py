"""The registered queries of this folder: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import binary, bpe, decontam, jaccard, katz, langid, merkle, quality, repair, simhash, spans, suffix, warc


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op2_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(table(spark, sf_dir, "documents"))


def op3_warc_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.round_trip(table(spark, sf_dir, "pages")))


def op4_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.digests(binary.token_records(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.held_out_scores(table(spark, sf_dir, "documents"))


def op7_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.remove_spans(suffix.duplicate_spans(table(spark, sf_dir, "documents"))))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digests(spans.span_duplicates(table(spark, sf_dir, "documents")))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_bpe_tree, op2_repetition_quality, op3_warc_boundary, op4_language_hd, op5_binary_records, op6_katz_backoff,
    op7_simhash_gray, op8_decontamination, op9_suffix_dedup, op10_sentence_spans,
    op11_jaccard_join, op12_merkle_manifest, op13_conversation_repair)}

SQL: dict[str, str] = {"op3_warc_boundary": warc.SQL, "op11_jaccard_join": jaccard.SQL, "op12_merkle_manifest": merkle.SQL}
