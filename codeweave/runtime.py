"""Session helper and the shared scratch area that long plans cut their lineage with.

Everything staged here lives in the folder the cluster names in ``spark.checkpoint.dir``, so any
executor (or a replacement for a lost one) can read it back.  A folder of our own is made only
under a local master where that setting is absent, as in tests; on a cluster its absence is an error.
What a table is staged from is not needed again, so the shuffle files of its job are removed with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: From here on an estimate stands for a size that is not known.
UNKNOWN_BYTES = 1 << 60


def session(app: str = "codeweave", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; under a local master without one a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_codeweave_scratch", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="codeweave-")
            spark._codeweave_scratch = root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/codeweave-{name}-{uuid.uuid4().hex}"
    _LIVE.append(path)
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs run inside."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def tidy(spark: SparkSession):
    """Shuffle files go with the job that made them, for the jobs run inside."""
    return setting(spark, _CLEANUP, "true")


def stage(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage there; ``by`` names
    a column whose values get folders of their own."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    with tidy(spark):
        (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeweave_path = path
    return out


def discard(*tables: DataFrame, below: str = "") -> None:
    """Delete staged tables, or a folder below them, that nothing reads any more."""
    for df in tables:
        drop(df.sparkSession, df._codeweave_path + below)


def staged() -> frozenset[str]:
    """The paths staged so far, for ``clear`` and ``settle``."""
    return frozenset(_LIVE)


def clear(spark: SparkSession, since: frozenset[str]) -> None:
    """Delete all that was staged after ``since``."""
    for path in [path for path in _LIVE if path not in since]:
        drop(spark, path)


def settle(df: DataFrame, name: str, since: frozenset[str]) -> DataFrame:
    """Stage a result and delete all else that was staged after ``since``."""
    path = scratch(df.sparkSession, name)
    out = stage(df, name, path)
    clear(df.sparkSession, since | {path})
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged path through Hadoop's file system layer."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _LIVE:
        _LIVE.remove(path)


def release(spark: SparkSession) -> None:
    """Delete everything staged so far; for callers that have written out what they need."""
    for path in list(_LIVE):
        drop(spark, path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of all that a plan reads, in bytes; no job is run.

    The leaves are summed, as the estimate of a join is the product of its sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def parts_for(df: DataFrame, per_part: int = 64 << 20, least: int | None = None) -> int:
    """Partitions that keep each at about ``per_part`` estimated bytes, never fewer than the session's.

    A plan whose size Catalyst does not know (rows from the driver) gets no more than it has now.
    """
    least = least if least is not None else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, df.rdd.getNumPartitions() if size >= UNKNOWN_BYTES else -(-size // per_part))
