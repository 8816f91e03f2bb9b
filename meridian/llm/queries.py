"""The registered queries of the subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, filter_audit, infilling, licenses, media, near_dedup, oracles, packing, quality, substring_dedup, suffix_dedup, token_counts, toxicity
from .common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages_report(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = toxicity.scored(docs, grammar)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "clauses")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), digest=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(documents(spark, sf_dir)).drop("detections")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.later_copies_report(documents(spark, sf_dir))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(filter_audit.failure_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.infilled_report(documents(spark, sf_dir))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_media": op9_media,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_infilling": op13_infilling,
}
#: The others are beyond SQL: removed bytes, learned scores, tokenizers, rules and files. tests/llm
#: holds each operator against a brute-force version.
ORACLES = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op2_near_dedup": oracles.NEAR_DEDUP,
    "op5_quality_rules": oracles.QUALITY_RULES,
    "op11_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op12_filter_audit": oracles.FILTER_AUDIT,
    "op13_infilling": oracles.INFILLING,
}
