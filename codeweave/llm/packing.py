"""Hierarchical best-fit packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut; the first piece takes the remainder, so all others are
full sequences of their own.  The rest is packed in rounds.  In a round every partition packs its
items best-fit in decreasing length, ``MERGE_ITEMS`` at a time, and emits the bins that are nearly full; the
underfull bins go on, as items, to fewer partitions.  Rounds end when one task has packed all that is left at once,
or when a round merged fewer than one item in a hundred (more rounds would gather ever more bins for nothing);
what is open then is emitted as it is.  No task holds more than ``MERGE_ITEMS`` items, however large its partition.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are packed each;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.llm import tokens

#: Items that a task packs at a time.
MERGE_ITEMS = 50_000
PIECES = "rid long, k long, piece int, start long, length long, ids_crc32 long"
BINS = "len int, rids array<long>"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of item positions.  Open bins are found by a bit set of
    their free space, so an item costs constant time."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        left = free - need
        stacks[left].append(b)
        mask |= 1 << left
    return bins


def cut(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every document, staged: a row id, key, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        rid = TaskContext.get().partitionId() << 33
        for batch in tokens.slices(batches, "t"):
            out: list[tuple] = []
            for k, ids in zip(batch.column("k").to_pylist(), enc.encode(batch.column("t"))):
                flat = np.frombuffer(ids + end, dtype=enc.dtype).astype("<u4")
                n = len(flat)
                first = (n - 1) % capacity + 1
                a, b, piece = 0, first, 0
                while a < n:
                    out.append((rid, k, piece, a, b - a, zlib.crc32(flat[a:b])))
                    a, b, piece, rid = b, b + capacity, piece + 1, rid + 1
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["rid", "k", "piece", "start", "length", "ids_crc32"])

    rows = df.select(df[key].cast("long").alias("k"), df[text].alias("t"))
    with tokens.bounded_batches(df.sparkSession):
        return runtime.stage(rows.mapInArrow(pieces, PIECES), "pieces")


def _round(items: DataFrame, capacity: int, full: int, most: int) -> DataFrame:
    """The bins of every ``most`` items of a partition: len, rids, done."""

    def best(own: list[tuple]) -> pd.DataFrame:
        own.sort(key=lambda x: (-x[0], x[1][0]))
        bins = best_fit([n for n, _ in own], capacity)
        size = [sum(own[i][0] for i in b) for b in bins]
        return pd.DataFrame(
            {
                "len": np.array(size, dtype=np.int32),
                "rids": [np.concatenate([own[i][1] for i in b]) if len(b) > 1 else own[b[0]][1] for b in bins],
                "done": np.array([s >= full for s in size], dtype=bool),
            }
        )

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[tuple] = []
        for frame in frames:
            own += zip(frame["len"].tolist(), frame["rids"].tolist())
            while len(own) >= most:
                yield best(own[:most])
                own = own[most:]
        if own:
            yield best(own)

    return items.mapInPandas(pack, BINS + ", done boolean")


def pack_items(pieces: DataFrame, capacity: int, full: int, fan_in: int = 8, most: int = MERGE_ITEMS) -> DataFrame:
    """(sequence_id, rids) of every sequence; ``pieces`` has rid and length."""
    spark = pieces.sparkSession
    alone = pieces.where(F.col("length") >= full).select(F.array("rid").alias("rids"))
    items = pieces.where(F.col("length") < full).select(F.col("length").cast("int").alias("len"), F.array("rid").alias("rids"))
    parts = max(1, items.rdd.getNumPartitions())
    finished, before = [alone], None
    while True:
        packed = runtime.stage(_round(items, capacity, full, most), "bins")
        finished.append(packed.where("done").select("rids"))
        rest = packed.where("not done").select("len", "rids")
        left = rest.count()
        if left == 0:
            break
        if parts == 1 and before is not None and before <= most or before is not None and left > 0.99 * before:
            finished.append(rest.select("rids"))
            break
        before = left
        parts = max(1, -(-left // most), -(-parts // fan_in) if left > most else 1)
        items = rest.repartition(parts)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select(F.element_at("rids", 1).alias("sequence_id"), "rids")


def pack(
    df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, capacity: int = 1024, full: int | None = None
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    since = runtime.staged()
    pieces = cut(df, key, text, tokenizer, end_id, capacity)
    sequences = pack_items(pieces, capacity, full or capacity - capacity // 128)
    placed = sequences.select("sequence_id", F.posexplode("rids").alias("pos", "rid")).join(pieces, "rid")
    w = Window.partitionBy("sequence_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select(
        F.col("k").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"),
    )
    return runtime.settle(out, "packed", since)
