"""Weighted rendezvous sharding of stable record keys.

Each key draws one pseudo-random number per shard and goes to the shard with the best weighted
draw.  A further shard only adds one more draw, so a row either stays or moves into the new shard.

Defined cases: a null key is a key of its own (all such rows share a shard); repeated keys share a
shard and get different slots; a null text has size 8 and crc32 0; an empty table gives an empty
result; columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave import runtime


def rendezvous(key: Column, weights: Sequence[float], seed: int = 7) -> tuple[Column, Column]:
    """(shard, best score) of a key over ``weights``; equal scores go to the lower shard.

    The score of shard i is -ln(u)/w_i with u uniform in (0, 1), and the least score wins: shard i
    wins with probability w_i / sum(w).
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")

    def score(i: int, w: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), key), 11)
        return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / w

    best = F.array_min(F.array(*[F.struct(score(i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]))
    return best["i"], best["s"]


def assign_shards(
    df: DataFrame, key: str, text: str, weights: Sequence[float], extra_weight: float = 1.0, seed: int = 7
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots are gapless within a shard.  They come from two levels, so that no shard is ever held in
    one task: rows are numbered within (shard, input partition), and the partitions' bases are
    prefix sums of their counts.
    """
    spark = df.sparkSession
    k = df[key].cast("string")
    shard, score = rendezvous(k, weights, seed)
    new = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(len(weights)), k), 11)
    new_score = -F.log((new.cast("double") + 0.5) / float(1 << 53)) / extra_weight
    rows = df.select(
        df[key].alias("_key"),
        (F.coalesce(F.octet_length(df[text]), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(df[text].cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        shard.alias("shard"),
        F.when(new_score < score, F.lit(len(weights))).otherwise(shard).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("_part"),
    )
    # Counting and numbering must see the same partitions, so the narrow rows are written once.
    rows = runtime.stage(rows, "shards")
    w = Window.partitionBy("shard", "_part")
    numbered = rows.withColumn(
        "_n", F.row_number().over(w.orderBy("_key", "text_crc32", "size")).cast("long") - 1
    )
    bases = (
        rows.groupBy("shard", "_part")
        .count()
        .withColumn("_base", F.sum("count").over(Window.partitionBy("shard").orderBy("_part")) - F.col("count"))
        .drop("count")
    )
    return numbered.join(bases, ["shard", "_part"]).select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_n") + F.col("_base")).cast("long").alias("slot"),
        "grown_shard",
    )
