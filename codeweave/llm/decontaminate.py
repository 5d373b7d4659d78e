"""Find benchmark items inside documents by size-partitioned MinHash containment search.

Items are put in partitions by the number of their shingles, in powers of two.  For a partition
whose items have at most s, every document is read through overlapping windows of 2 s shingles taken
every s: wherever s consecutive shingles hold an item, one window holds them all.  A window has a
bounded number of shingles, so containment in it is a bounded Jaccard similarity however long the
document is, and a fixed number of minwise values finds it: an item that is contained to 0.8 shares
each value with the window with a probability of 0.19 at least, so all of ``VALUES`` miss with less
than 2e-6.  Candidates are confirmed by exact containment of the item's shingles in the whole
document's shingle set.

The item table is taken in slices of a bounded number of bytes, and each slice's index is broadcast
in its turn, so a broadcast does not grow with the item table.

Defined cases: items or documents of fewer words than a shingle have their whole word sequence as
their only shingle; null, empty and blank texts contain nothing and are contained in nothing;
repeated documents are reported each, equal items once; null ids are ordinary values; empty tables give no
rows; other columns are carried by ``drop_contaminated`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.llm import shingles, tokens

WIDTH = 5
VALUES = 64
#: Bytes of item text in one broadcast index, which takes some eight times as many in a worker; each slice is one more scan.
SLICE_BYTES = 16 << 20
_SEEDS = shingles.seeds(VALUES, 4)


@dataclass
class Index:
    """Items of one broadcast: their shingle sets and, by size partition and hash, their minwise values."""

    flat: np.ndarray
    off: np.ndarray
    spans: list[int]
    #: For every span, one (sorted values, their items, bit map of the values' top 16 bits) per hash.
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def build_index(texts: list[str | None]) -> Index:
    """The partitions of an item list, by the number of shingle positions in powers of two."""
    column = pa.array(texts, pa.large_string())
    flat, off = shingles.shingle_sets(column, WIDTH)
    _, positions = shingle_stream(column)
    positions = np.diff(positions)
    span = np.where(positions > 0, 1 << np.ceil(np.log2(np.maximum(positions, 1))).astype(np.int64), 0)
    sig = shingles.signature(flat, off, _SEEDS)
    spans = sorted({int(x) for x in span if x})
    tables = []
    for s in spans:
        own = np.flatnonzero(span == s)
        per = []
        for j in range(VALUES):
            value = sig[own, j]
            order = np.argsort(value, kind="stable")
            bits = np.zeros(1 << 16, dtype=bool)
            bits[(value >> np.uint64(48)).astype(np.int64)] = True
            per.append((value[order], own[order], bits))
        tables.append(per)
    return Index(flat, off, spans, tables)


def candidates(index: Index, stream: np.ndarray, soff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) pairs that share a minwise value in a window of the item's partition.

    Texts are cut into cells of the least span; a window is the least over a power of two of cells,
    doubled up from pair to pair and stopped at the text's last cell.
    """
    cell = index.spans[0]
    n_cells = -(-np.diff(soff) // cell)
    if not n_cells.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(([0], np.cumsum(n_cells)))
    owner = np.repeat(np.arange(len(n_cells)), n_cells)
    place = np.arange(first[-1]) - first[owner]
    cuts = soff[owner] + place * cell
    last = first[owner + 1] - 1
    here = np.arange(first[-1])
    base = stream ^ (stream >> np.uint64(32))
    texts, items = [], []
    for j, seed in enumerate(_SEEDS):
        low = np.minimum.reduceat(base * seed, cuts)
        width = 1
        for span, tables in zip(index.spans, index.tables):
            while width < 2 * span // cell:
                low = np.minimum(low, low[np.minimum(here + width, last)])
                width *= 2
            value, item, bits = tables[j]
            hit = np.flatnonzero(bits[(low >> np.uint64(48)).astype(np.int64)])
            hit = hit[place[hit] % (span // cell) == 0]
            lo, hi = np.searchsorted(value, low[hit], "left"), np.searchsorted(value, low[hit], "right")
            some = np.flatnonzero(hi > lo)
            if len(some):
                texts.append(np.repeat(owner[hit[some]], hi[some] - lo[some]))
                items.append(np.concatenate([item[a:b] for a, b in zip(lo[some], hi[some])]))
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)]), axis=1)
    return both[0], both[1]


def shingle_stream(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of every text in order, with repeats, and n + 1 offsets."""
    h, off, _, _ = shingles.words(column)
    m = max(0, len(h) - width + 1)
    s = np.zeros(m, dtype=np.uint64)
    for j in range(width):
        s += h[j : j + m] * shingles._PLACE[j]
    s = shingles.mix(s)
    parts, ends = [], [0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        n = b - a
        if n >= width:
            own = s[a : b - width + 1]
        elif n:
            own = shingles.mix((h[a:b] * shingles._PLACE[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            own = s[:0]
        parts.append(own)
        ends.append(ends[-1] + len(own))
    return (np.concatenate(parts) if parts else s), np.array(ends)


def matches_in(index: Index, column: pa.Array, threshold: float) -> list[tuple[int, int, int, int]]:
    """(text, item, item's shingles, shared) for every confirmed pair of a batch."""
    stream, soff = shingle_stream(column)
    if not len(stream) or not index.spans:
        return []
    texts, items = candidates(index, stream, soff)
    out = []
    for i in np.unique(texts).tolist():
        own = np.unique(stream[soff[i] : soff[i + 1]])
        for x in items[texts == i].tolist():
            item = index.flat[index.off[x] : index.off[x + 1]]
            where = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[where] == item).sum())
            if shared >= threshold * len(item) - 1e-9:
                out.append((i, x, len(item), shared))
    return out


def find_items(
    df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, threshold: float = 0.8
) -> DataFrame:
    """(th, key, item_key, item_shingles, shared, containment) of all confirmed pairs.

    ``th`` is a hash of the document's text.
    """
    spark = df.sparkSession
    sized = items.select(items[item_key].cast("long").alias("i"), items[item_text].alias("t"), F.coalesce(F.octet_length(items[item_text]), F.lit(0)).cast("long").alias("b")).distinct()
    total = sized.agg(F.sum("b")).first()[0] or 0
    slices = max(1, -(-total // SLICE_BYTES))
    rows = df.select(df[key].cast("long").alias("k"), F.xxhash64(df[text]).alias("th"), df[text].alias("t"))
    found = []
    for s in range(slices):
        own = sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == s).orderBy("i", "t").select("i", "t")
        got = [(r["i"], r["t"]) for r in own.collect()]  # one slice: a bounded part of the items
        shipped = spark.sparkContext.broadcast((build_index([t for _, t in got]), [i for i, _ in got]))
        found.append(rows.mapInArrow(_matcher(shipped, threshold), "th long, k long, i long, item_shingles long, shared long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.select(
        "th", F.col("k").alias(key), F.col("i").alias(item_key), "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment")
    )
    with tokens.bounded_batches(spark):
        return runtime.stage(out, "found-items")


def _matcher(shipped, threshold: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shipped.value
        for batch in tokens.slices(batches, "t", 512 << 10):
            got = matches_in(index, batch.column("t"), threshold)
            if got:
                at = pa.array([g[0] for g in got])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("th").take(at), batch.column("k").take(at), pa.array([ids[g[1]] for g in got], pa.int64()),
                        pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64()),
                    ],
                    names=["th", "k", "i", "item_shingles", "shared"],
                )

    return match


def contaminated(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, threshold: float = 0.8) -> DataFrame:
    """(key, item_key, item_shingles, shared, containment): one row per document and item found in it."""
    return find_items(df, key, text, items, item_key, item_text, threshold).drop("th")


def drop_contaminated(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` that contain no item."""
    hits = find_items(df, key, text, items, item_key, item_text, threshold)
    hits = hits.select(F.col(key).alias("_k"), F.col("th").alias("_th")).distinct()
    rows = df.select(F.struct("*").alias("row"), df[key].cast("long").alias("_k"), F.xxhash64(df[text]).alias("_th"))
    return rows.join(hits, rows["_k"].eqNullSafe(hits["_k"]) & (rows["_th"] == hits["_th"]), "left_anti").select("row.*")
