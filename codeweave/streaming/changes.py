"""Change records as a stream: an extension of the batch ``update``, which has no streaming itself.

A folder of change files (path, old_path, type, as JSON lines) is read by Structured Streaming.  Every
micro-batch upserts the file index and records which modules the change reaches.  The index is kept as
versioned tables: a batch writes ``index/v=<batch id>`` and reads the greatest version below its own,
so a batch that is run again after a failure writes the same version from the same input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeweave.operators import changes, graph, resolve
from codeweave.operators.schema import CHANGES


def _versions(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def current_index(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest index below ``folder``, or the newest one older than version ``before``."""
    versions = [v for v in _versions(spark, f"{folder}/index") if before is None or v < before]
    if not versions:
        raise FileNotFoundError(f"no index below {folder}")
    return spark.read.parquet(f"{folder}/index/v={versions[-1]}")


def start_index(index: DataFrame, folder: str) -> None:
    """Write the index that the first batch changes, as version -1."""
    index.write.mode("overwrite").parquet(f"{folder}/index/v=-1")


def apply_batch(batch: DataFrame, batch_id: int, folder: str, modules: DataFrame, scan: Callable[[], DataFrame]) -> None:
    """Upsert the index by one batch of changes and write the ids of the affected modules."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        new = changes.upsert(current_index(spark, folder, before=batch_id), scan(), batch)
        new.write.mode("overwrite").parquet(f"{folder}/index/v={batch_id}")
        hit = graph.affected(batch, modules, resolve.edges_of(spark.read.parquet(f"{folder}/index/v={batch_id}")))
        hit.select("id").write.mode("overwrite").parquet(f"{folder}/affected/batch={batch_id}")
    finally:
        batch.unpersist()


def follow_changes(
    spark: SparkSession, incoming: str, folder: str, modules: DataFrame, scan: Callable[[], DataFrame], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Run ``apply_batch`` over the change files of ``incoming``, one file a batch."""
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(incoming)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_batch(df, i, folder, modules, scan))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
