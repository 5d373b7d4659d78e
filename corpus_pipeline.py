"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``docs`` is what the predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.llm import decontaminate, line_dedup, minhash_dedup, packing, quality, tokens
from codeweave.llm.queries import table, tokenizer_file

#: Lines that this many documents share go.
COMMON = 10
#: Jaccard similarity, in percent, and trees that miss a pair at it with 8e-5.
SIMILAR, TREES = 80, 9


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine accepts; labels of the held-out fold are not learnt from."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, "doc_id", "text", "quality", ~quality.held_out(F.col("doc_id")))
    return quality.scored(docs, "text", model).where(F.col("score") >= quality.CUTOFF).select("row.*")


def _replace(row: Column, names: list[str], new: dict[str, Column]) -> list[Column]:
    return [new[c].alias(c) if c in new else row[c].alias(c) for c in names]


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that at least ``COMMON`` documents share; ``n_chars`` follows the text."""
    out = line_dedup.drop_common_lines(docs, "doc_id", "text", COMMON)
    row = F.col("row")
    text = F.when(F.size("dropped") == 0, row["text"]).otherwise(line_dedup.kept_text())
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("dropped") == 0, row["n_chars"]).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*_replace(row, docs.columns, new))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least id."""
    return minhash_dedup.keep_one(docs, "doc_id", "text", SIMILAR, trees=TREES)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences of 1024 tokens."""
    return packing.pack(docs, "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), 2, 1024)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", common_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_items),
    ("packing", sequences),
]

#: Training, minwise trees and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    before, root = None, f"{runtime.shared_dir(spark)}/codeweave-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path, since = f"{root}/{name}", runtime.staged()
        with tokens.bounded_batches(spark):
            docs = runtime.stage(stage(spark, docs, sf_dir), name, path)
        runtime.clear(spark, since)
        if before:
            runtime.drop(spark, before)
        before = path
    return docs
