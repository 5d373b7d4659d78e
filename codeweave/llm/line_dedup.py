"""Drop lines whose key occurs in many documents, with levelled sorted runs of line hashes.

``LineRuns`` is a log-structured store.  A run is a table of (h1, h2, n): the 128-bit hash of a line
key and the number of documents it was met in, bucketed and sorted by the hash.  A new batch is
reduced to such rows, merge-anti-joined against the settled runs (keys known to have reached the
threshold need no further counting) and added as a run of level 0.  When a level holds ``fanout``
runs they are merged into one run of the next level, and keys that reach the threshold move to a
settled run.  Runs share their bucketing, so merges and anti-joins need no exchange of the runs.  Their buckets
follow the size of what is counted.

``drop_common_lines`` hashes the lines of every text once; the batches, and the search for the lines to drop,
read these hashes, and the text is read a second time only to be put together again.

Defined cases: a null or empty text is one empty line; a line counts once per row, however often
the row repeats it; equal rows are documents of their own and get equal results; a null id is an
ordinary value; an empty table gives no rows; other columns are carried untouched by
``drop_common_lines`` whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweave import runtime

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2", "n")])


def line_keys(lines: Column) -> Column:
    """The lines without ASCII white space at their ends, A-Z folded; pure ASCII takes the fast path.

    One step a transform, as a lambda evaluates what it names twice.
    """
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(_SPACE)))
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER)))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """The 128-bit hash (h1, h2) of every line's key; null for keys of fewer code points."""
    both = lambda key: F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
    return F.transform(line_keys(lines), lambda key: F.when(F.char_length(key) >= min_chars, both(key)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


#: Bytes of line hashes to a bucket.
BUCKET_BYTES = 32 << 20


class LineRuns:
    """Counts of documents by line hash, kept as levelled sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 2, buckets: int | None = None) -> None:
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self._paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = runtime.scratch(self.spark, name)
        (
            rows.select("h1", "h2", "n").repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", self._paths[name]).format("parquet").saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        runtime.drop(self.spark, self._paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs' rows with counts summed: a chain of full outer merge joins, as keys are unique in a run."""
        out = self.spark.createDataFrame([], _RUN) if not names else self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("n", "m")
            total = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            out = out.join(more, ["h1", "h2"], "full").select("h1", "h2", total.alias("n"))
        return out

    def add(self, keys: DataFrame) -> None:
        """Count a batch of (h1, h2) rows, one for each document and distinct key."""
        counts = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for name in self.settled:
            counts = counts.join(self.spark.table(name), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(self.levels[level], level + 1)
            level += 1

    def _compact(self, names: list[str], level: int | None) -> None:
        merged = self._merged(names)
        old = list(names)
        reached = self._write(merged.where(F.col("n") >= self.threshold))
        self.settled.append(reached)
        if level is not None:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(self._write(merged.where(F.col("n") < self.threshold)))
        names.clear()
        for name in old:
            self._drop(name)

    def common(self) -> DataFrame:
        """(h1, h2) of every key that reached the threshold; a plain staged table, so that a join
        against it can be split where one key is hot."""
        rest = [name for level in self.levels for name in level]
        # A settled key carries a count of at least the threshold into the merge.
        counts = self._merged([*self.settled, *rest])
        out = runtime.stage(counts.where(F.col("n") >= self.threshold).select("h1", "h2"), "common-lines")
        for name in [*rest, *self.settled]:
            self._drop(name)
        self.levels, self.settled = [[]], []
        return out


def drop_common_lines(
    df: DataFrame, key: str, text: str, threshold: int, min_chars: int = 1, batches: int = 3, fanout: int = 2
) -> DataFrame:
    """(row, lines, dropped): the row as a struct, its lines, and the sorted positions to drop.

    The rows are taken as ``batches`` arrivals (by hash of the row) through one ``LineRuns``.
    """
    spark = df.sparkSession
    th = F.xxhash64(df[text])
    hashes = df.select(
        df[key].alias("k"), th.alias("th"), F.pmod(F.xxhash64(df[key], th), F.lit(batches)).cast("int").alias("batch"),
        line_hashes(lines_of(df[text]), min_chars).alias("hs"),
    )
    hashes = runtime.stage(hashes, "line-hashes", by="batch")
    runs = LineRuns(spark, threshold, fanout, runtime.parts_for(hashes, BUCKET_BYTES))
    for b in range(batches):
        # Equal lines of a row are one within its array, so only counts are exchanged.
        own = hashes.where(F.col("batch") == b).select(F.explode(F.array_distinct("hs")).alias("h"))
        runs.add(own.where("h is not null").select("h.h1", "h.h2"))
    common = runs.common()

    lines = hashes.select("k", "th", F.posexplode("hs").alias("pos", "h")).where("h is not null").select("k", "th", "pos", "h.h1", "h.h2")
    hits = lines.join(common, ["h1", "h2"], "left_semi")
    dropped = hits.groupBy("k", "th").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    rows = df.select(F.struct("*").alias("row"), df[key].alias("_k"), F.xxhash64(df[text]).alias("_th"), df[text].alias("_t"))
    joined = rows.join(dropped, rows["_k"].eqNullSafe(dropped["k"]) & (rows["_th"] == dropped["th"]), "left")
    return joined.select(
        "row", lines_of(F.col("_t")).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )


def kept_text(lines: str = "lines", dropped: str = "dropped") -> Column:
    """The lines that stay, joined again; linear in the number of lines."""
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    keep = F.array_except(every, F.col(dropped))
    return F.when(F.size(dropped) == 0, F.array_join(lines, "\n")).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get(F.col(lines), i)), "\n")
    )


def line_report(df: DataFrame, key: str, text: str, threshold: int, min_chars: int = 1) -> DataFrame:
    """Per row: key, n_lines, n_dropped, kept_sha256."""
    since = runtime.staged()
    out = drop_common_lines(df, key, text, threshold, min_chars)
    report = out.select(
        F.col("row")[key].alias(key),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"),
    )
    return runtime.settle(report, "line-report", since)
