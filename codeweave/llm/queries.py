"""The ten operators applied to the driver's tables, each at its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import decontaminate, embedding_dedup, license_scan, line_dedup, minhash_dedup, oracle, packing, pitman_yor, quality, sharding, token_files

SHARDS = 24


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file, wherever the installed package keeps it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.token_table(docs, "doc_id", "text", tokenizer_file("word_bpe_49k.json"), 2, drops_space=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), "doc_id", "text", threshold=10)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, "doc_id", "text", items, "item_id", "text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return embedding_dedup.near_duplicates(vectors, "vec_id", "embedding", "label", threshold=0.98)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "text", passages=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), 2, capacity=1024)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicate_table(table(spark, sf_dir, "documents"), "doc_id", "text", percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_token_files, op3_line_dedup, op4_decontaminate, op5_quality, op6_pitman_yor, op7_embedding_dedup, op8_license_scan, op9_packing, op10_minhash_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
