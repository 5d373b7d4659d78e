"""A factorisation machine that scores documents for quality.

Features of a whole text: hashed words (a bag, square-rooted and scaled to unit length), structure
statistics (each in bins, one bin on per statistic) and the text's own metadata (its length in bytes,
words and lines).  The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ],

so every pair of features interacts at a cost linear in the features that are on.

Only the training sample is bounded: at most ``SAMPLE`` labelled rows, those with the least hash of
their id.  All rows are scored, each by itself, with a model of fixed size.

Defined cases: a null text is an empty one and gets a score; null labels, and labels of unknown ids,
are left out; of several labels of an id the least counts; without both labels in the sample there
is nothing to learn and every row scores ``PRIOR``; repeated rows are scored each; a null id has no label and
is not held out; ids are integers, or text that holds one, and others are an error of the cast; an empty table
gives no rows; labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.llm import shingles, tokens

SAMPLE = 16_000
#: Least number of training steps, so that a small sample is fitted as closely as a large one.
STEPS = 500
WORDS = 1 << 14
BINS = 12
PRIOR = 0.7
CUTOFF = 0.7
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True

#: Upper edges of the bins of every statistic; ratios share one grid, lengths are logarithms.
_RATIO = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])
_LOG = np.array([0.7, 1.4, 2.1, 2.8, 3.5, 4.2, 5.0, 6.0, 7.0, 8.0, 9.5])
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "upper", "symbol", "digit", "distinct_words", "top_word",
    "repeats_previous", "distinct_pairs", "bare_symbols", "symbol_ended", "distinct_lines", "longest_run",
)
FEATURES = WORDS + len(STATISTICS) * BINS


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=run[1:])
    return (run[off[1:]] - run[off[:-1]]).astype(np.float64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature index, value, n + 1 offsets) of the texts of an Arrow string array."""
    flat, off = shingles.buffers(column)
    n = len(off) - 1
    h, woff, starts, ends = shingles.words(column)
    count = np.diff(woff).astype(np.float64)
    size = np.diff(off).astype(np.float64)
    some_w, some_b = np.maximum(count, 1), np.maximum(size, 1)
    newline = flat == 10
    lines = _sums(newline, off) + 1
    symbol = _SYMBOL[flat]
    stats = np.zeros((n, len(STATISTICS)))
    stats[:, 0], stats[:, 1], stats[:, 2] = np.log1p(size), np.log1p(count), np.log1p(lines)
    stats[:, 3] = np.log1p(_sums(~shingles._SPACE[flat], off) / some_w) * 2
    stats[:, 4] = _sums(_UPPER[flat], off) / np.maximum(_sums(_LETTER[flat], off), 1)
    stats[:, 5] = _sums(symbol, off) / some_b
    stats[:, 6] = _sums(_DIGIT[flat], off) / some_b
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    same[woff[:-1][woff[:-1] < len(h)]] = False
    stats[:, 9] = _sums(same, woff) / some_w
    before = np.concatenate(([0], np.cumsum(symbol)))
    bare = (before[ends] - before[starts]) == (ends - starts) if len(h) else np.zeros(0, bool)
    stats[:, 11] = _sums(bare, woff) / some_w
    closing = symbol[ends - 1] if len(h) else np.zeros(0, bool)
    stats[:, 12] = _sums(closing, woff) / some_w
    # Lines as differences of a running hash of their words; empty lines are left out.
    line_of = np.cumsum(newline)[starts] if len(h) else np.zeros(0, np.int64)
    pairs = shingles.mix(h[:-1] * shingles._PLACE[0] + h[1:] * shingles._PLACE[1]) if len(h) > 1 else np.empty(0, np.uint64)
    index, value, stop = [], [], np.zeros(n + 1, dtype=np.int64)
    for i in range(n):
        a, b = int(woff[i]), int(woff[i + 1])
        idx = np.empty(0, np.int64)
        val = np.empty(0)
        if b > a:
            distinct, times = np.unique(h[a:b], return_counts=True)
            stats[i, 7] = len(distinct) / (b - a)
            stats[i, 8] = times.max() / (b - a)
            stats[i, 10] = len(np.unique(pairs[a : b - 1])) / (b - a - 1) if b - a > 1 else 1.0
            own = line_of[a:b]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sums = np.add.reduceat(h[a:b], first)
            stats[i, 13] = len(np.unique(sums)) / len(first)
            breaks = np.flatnonzero(np.concatenate(([True], ~same[a + 1 : b], [True])))
            stats[i, 14] = np.log1p(np.diff(breaks).max())
            slot = (distinct >> np.uint64(50)).astype(np.int64)
            idx, inv = np.unique(slot, return_inverse=True)
            val = np.sqrt(np.bincount(inv, weights=times))
            val /= np.sqrt((val * val).sum())
        index.append(idx)
        value.append(val)
        stop[i + 1] = stop[i] + len(idx) + len(STATISTICS)
    logs = [i for i, name in enumerate(STATISTICS) if name.startswith("log") or name in ("mean_word", "longest_run")]
    bins = np.empty((n, len(STATISTICS)), dtype=np.int64)
    for j in range(len(STATISTICS)):
        bins[:, j] = np.searchsorted(_LOG if j in logs else _RATIO, stats[:, j]) + WORDS + j * BINS
    out_i = np.empty(int(stop[-1]), dtype=np.int32)
    out_v = np.empty(int(stop[-1]), dtype=np.float32)
    on = 1 / np.sqrt(len(STATISTICS))
    for i in range(n):
        a, b = int(stop[i]), int(stop[i + 1])
        m = len(index[i])
        out_i[a : a + m], out_v[a : a + m] = index[i], value[i]
        out_i[a + m : b], out_v[a + m : b] = bins[i], on
    return out_i, out_v, stop


@dataclass
class FactorisationMachine:
    """w0, w and the low-rank factors v; ``constant`` replaces them where nothing could be learnt."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    constant: float | None = None

    def raw(self, index: np.ndarray, value: np.ndarray, stop: np.ndarray) -> np.ndarray:
        at = stop[:-1]
        xv = self.v[index] * value[:, None]
        s = np.add.reduceat(xv, at, axis=0)
        q = np.add.reduceat((xv * xv).sum(axis=1), at)
        return self.w0 + np.add.reduceat(self.w[index] * value, at) + 0.5 * ((s * s).sum(axis=1) - q)

    def score(self, index: np.ndarray, value: np.ndarray, stop: np.ndarray) -> np.ndarray:
        n = len(stop) - 1
        if self.constant is not None or n == 0:
            return np.full(n, self.constant if self.constant is not None else PRIOR)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, stop).astype(np.float64), -30, 30)))


def fit(
    index: np.ndarray, value: np.ndarray, stop: np.ndarray, y: np.ndarray, rank: int = 6, epochs: int = 8,
    rate: float = 0.03, decay: float = 1e-4, batch: int = 256, seed: int = 5,
) -> FactorisationMachine:
    """Logistic loss, Adam on mini-batches; the same rows in the same order give the same model."""
    if len(y) == 0 or y.min() == y.max():
        return FactorisationMachine(0.0, np.zeros(0), np.zeros((0, 0)), PRIOR)
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-STEPS // -(-len(y) // batch)))
    size = FEATURES
    theta = np.zeros((size, rank + 1), dtype=np.float32)
    theta[:, 1:] = rng.normal(0, 0.05, (size, rank))
    model = FactorisationMachine(float(np.log(y.mean() / (1 - y.mean()))), theta[:, 0], theta[:, 1:])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    m0 = s0 = 0.0
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            spans = [np.arange(stop[r], stop[r + 1]) for r in rows]
            take = np.concatenate(spans)
            length = np.array([len(x) for x in spans])
            ends = np.concatenate(([0], np.cumsum(length)))
            i, x = index[take], value[take]
            p = model.score(i, x, ends)
            g = ((p - y[rows]) / len(rows)).astype(np.float32)
            per = np.repeat(g, length)
            xv = model.v[i] * x[:, None]
            sums = np.repeat(np.add.reduceat(xv, ends[:-1], axis=0), length, axis=0)
            grad = np.empty((len(i), rank + 1), dtype=np.float32)
            grad[:, 0] = per * x
            grad[:, 1:] = (per * x)[:, None] * (sums - xv)
            by = np.argsort(i, kind="stable")
            own = i[by]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            touched = own[first]
            total = np.add.reduceat(grad[by], first, axis=0) + decay * theta[touched]
            step += 1
            m[touched] = 0.9 * m[touched] + 0.1 * total
            s[touched] = 0.99 * s[touched] + 0.01 * total * total
            a, b = 1 - 0.9**step, 1 - 0.99**step
            theta[touched] -= rate * (m[touched] / a) / (np.sqrt(s[touched] / b) + 1e-6)
            g0 = float(g.sum())
            m0, s0 = 0.9 * m0 + 0.1 * g0, 0.99 * s0 + 0.01 * g0 * g0
            model.w0 -= rate * (m0 / a) / (np.sqrt(s0 / b) + 1e-6)
    return model


def _featurise(batches: Iterator[pa.RecordBatch], text: str):
    for batch in tokens.slices(batches, text, 512 << 10):
        yield batch, features(batch.column(text))


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable: Column) -> FactorisationMachine:
    """Fit on at most ``SAMPLE`` labelled rows of ``df`` for which ``usable`` holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("y"))
    known = known.where(usable).select(F.col(key).alias("k"), "y")
    known = known.orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    own = df.select(df[key].alias("k"), df[text].alias("t"))
    rows = own.join(F.broadcast(known), "k").select("k", "y", "t")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (i, v, stop) in _featurise(batches, "t"):
            ends = stop.tolist()
            cut = list(zip(ends[:-1], ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k").cast(pa.int64()), batch.column("y").cast(pa.int32()),
                    pa.array([i[a:b].astype("<u2").tobytes() for a, b in cut], pa.binary()),
                    pa.array([v[a:b].astype("<f2").tobytes() for a, b in cut], pa.binary()),
                ],
                names=["k", "y", "i", "v"],
            )

    # An id may repeat without bound; one of its rows is enough, so the bound on labels is one on rows.
    one = rows.mapInArrow(pack, "k long, y int, i binary, v binary").groupBy("k").agg(F.min(F.struct("y", "i", "v")).alias("f"))
    with tokens.bounded_batches(df.sparkSession):
        got = one.select("k", "f.y", "f.i", "f.v").toArrow()
    parts = sorted(zip(*(got.column(c).to_pylist() for c in ("k", "y", "i", "v"))))
    if not parts:
        return fit(np.empty(0, np.int32), np.empty(0, np.float32), np.zeros(1, np.int64), np.empty(0))
    index = np.frombuffer(b"".join(p[2] for p in parts), "<u2").astype(np.int32)
    value = np.frombuffer(b"".join(p[3] for p in parts), "<f2").astype(np.float32)
    stop = np.concatenate(([0], np.cumsum([len(p[2]) // 2 for p in parts])))
    return fit(index, value, stop, np.array([p[1] for p in parts], dtype=np.float64))


def scored(df: DataFrame, text: str, model: FactorisationMachine, score: str = "score") -> DataFrame:
    """(row, score): every row of ``df`` as a struct, and its score; to be run within ``tokens.bounded_batches``."""
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    rows = df.select(F.struct("*").alias("row"), df[text].alias("t"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _featurise(batches, "t"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(shipped.value.score(*found), pa.float64())], names=["row", score]
            )

    return rows.mapInArrow(run, f"row {kind}, {score} double")


def held_out(key: Column) -> Column:
    """The fold that labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality(df: DataFrame, labels: DataFrame, key: str, text: str, label: str = "quality") -> DataFrame:
    """Per row: key, held_out, score, predicted."""
    model = train(df, labels, key, text, label, ~held_out(F.col(key)))
    narrow = df.select(df[key].alias("k"), held_out(df[key]).alias("held_out"), df[text].alias("t"))
    out = scored(narrow, "t", model).select(
        F.col("row.k").alias(key), F.col("row.held_out").alias("held_out"), "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"),
    )
    with tokens.bounded_batches(df.sparkSession):
        return runtime.stage(out, "quality")
