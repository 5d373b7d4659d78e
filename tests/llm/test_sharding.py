import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweave.llm import queries, sharding

from .conftest import messy_rows


def check(rows, shards):
    slots = {}
    for r in rows:
        assert r["law"] == "key" and 0 <= r["shard"] < shards and r["grown_shard"] in (r["shard"], shards)
        slots.setdefault(r["shard"], []).append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_whole_table(spark, sf01):
    rows = queries.op1_sharding(spark, sf01).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    check(rows, 24)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 2 * len(rows) / 24
    moved = sum(r["grown_shard"] == 24 for r in rows)
    assert 0 < moved < 3 * len(rows) / 25


def test_growth_is_what_one_more_shard_gives(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit("t").alias("text"))
    small = {r["k"]: r for r in sharding.assign_shards(df, "k", "text", [1.0] * 7).collect()}
    large = {r["k"]: r for r in sharding.assign_shards(df, "k", "text", [1.0] * 8).collect()}
    assert all(small[k]["grown_shard"] == large[k]["shard"] for k in small)


def test_weights_set_the_shares(spark):
    df = spark.range(8000).select(F.col("id").alias("k"), F.lit("t").alias("text"))
    got = Counter(r["shard"] for r in sharding.assign_shards(df, "k", "text", [1.0, 3.0]).collect())
    assert 0.70 < got[1] / 8000 < 0.80
    for bad in ([], [1.0, 0.0], [-1.0]):
        with pytest.raises(ValueError):
            sharding.assign_shards(df, "k", "text", bad)


def test_messy_and_empty(messy, nothing):
    rows = sharding.assign_shards(messy, "doc_id", "text", [1.0] * 5).collect()
    assert len(rows) == len(messy_rows())
    check(rows, 5)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1] == [(8, 0)]
    assert sharding.assign_shards(nothing, "doc_id", "text", [1.0]).count() == 0


def test_the_winning_shard_by_hand(spark, sf01):
    """Every draw made again with another library: the least -ln(u) wins, with and without a further shard."""
    import math
    import struct

    import xxhash

    def draw(shard, key):
        h = 42
        for part in (struct.pack("<i", 7), struct.pack("<i", shard), str(key).encode()):
            h = xxhash.xxh64_intdigest(part, seed=h)
        return -math.log(((h >> 11) + 0.5) / (1 << 53))

    rows = queries.op1_sharding(spark, sf01).select("doc_id", "shard", "grown_shard").collect()
    for r in rows:
        drawn = [draw(i, r["doc_id"]) for i in range(queries.SHARDS + 1)]
        assert (r["shard"], r["grown_shard"]) == (drawn.index(min(drawn[:-1])), drawn.index(min(drawn)))
