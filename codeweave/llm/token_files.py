"""Token ids as flat binary files with 64-bit document offsets, read back through memory maps.

Layout, for part p of the output folder (attempt a is part of the name, and only the attempt that
the manifest names counts, so a task that is run again leaves no wrong file behind):

* ``tokens-p-a.bin``   unsigned little-endian ids, 2 bytes each if the vocabulary allows, else 4;
* ``offsets-p-a.bin``  n_docs + 1 unsigned 64-bit little-endian offsets into it, in ids;
* ``docs-p-a.bin``     n_docs signed 64-bit document ids (``NULL_ID`` for null).

The manifest has one row per part; a part's base (ids before it) is a prefix sum over the manifest.
Parts follow ascending document id, so part order and place within a part give the corpus order.

Defined cases: null and empty texts give the end id alone; null ids come first; rows that share an
id are all kept, ordered by a hash of their text; an empty table gives no files and no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.llm import tokens

NULL_ID = -(1 << 63)
MANIFEST = "part int, stem string, width int, n_docs long, n_tokens long"


def _open_fs(uri: str):
    """The file system and path of an address as Spark takes it; Hadoop's names of S3 are those of one scheme here."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _map(system, path: str, dtype: np.dtype) -> np.ndarray:
    """A memory map where the file system is a mounted one, else the file's bytes."""
    if system.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_token_files(
    df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, folder: str, drops_space: bool = False,
    per_part: int = 32 << 20,
) -> DataFrame:
    """Encode ``text`` in ascending ``key`` order into ``folder``; returns the staged manifest."""
    spark = df.sparkSession
    n = runtime.parts_for(df, per_part)
    rows = df.select(
        df[key].cast("long").alias("k"), df[text].alias("t"), F.xxhash64(df[text]).alias("h"),
        F.monotonically_increasing_id().alias("m"),
    )
    # The hash and the row number let equal keys, however many, spread over several parts.
    rows = rows.repartitionByRange(n, "k", "h", "m").sortWithinPartitions("k", "h", "m").select("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _open_fs(folder)
        system.create_dir(root, recursive=True)
        enc = tokens.encoder(tokenizer, drops_space)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        stem = f"{part:06d}-{uuid.uuid4().hex[:12]}"
        offset, docs, out = 0, 0, None
        for batch in tokens.slices(batches, "t"):
            if out is None:
                out = {k: system.open_output_stream(f"{root}/{k}-{stem}.bin") for k in ("tokens", "offsets", "docs")}
                out["offsets"].write(np.zeros(1, "<u8").tobytes())
            ids = [x + end for x in enc.encode(batch.column("t"))]
            ends = offset + np.cumsum([len(x) // enc.width for x in ids], dtype="<u8")
            out["tokens"].write(b"".join(ids))
            out["offsets"].write(ends.astype("<u8").tobytes())
            keys = batch.column("k").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            out["docs"].write(keys.astype("<i8").tobytes())
            offset, docs = int(ends[-1]), docs + len(ids)
        if out is not None:
            for f in out.values():
                f.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "stem": stem, "width": enc.width, "n_docs": docs, "n_tokens": offset}],
                schema=pa.schema([("part", pa.int32()), ("stem", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    with tokens.bounded_batches(spark):
        return runtime.stage(rows.mapInArrow(write, MANIFEST), "manifest", f"{folder}/manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with each part's ``base``; one row per part, so one window is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, key: str) -> DataFrame:
    """One row per document, read back from the files: key, start, n_tokens, ids_crc32."""
    files = with_bases(manifest)
    spread = files.repartition(runtime.parts_for(manifest), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                flat = _map(system, f"{root}/tokens-{row['stem']}.bin", np.dtype(f"<u{row['width']}"))
                offs = _map(system, f"{root}/offsets-{row['stem']}.bin", np.dtype("<u8"))
                docs = np.asarray(_map(system, f"{root}/docs-{row['stem']}.bin", np.dtype("<i8")))
                for at in range(0, len(docs), 4096):
                    o = np.asarray(offs[at : at + 4097]).astype(np.int64)
                    crc = [zlib.crc32(np.asarray(flat[a:b]).astype("<u4")) for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
                    d = docs[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(d, mask=d == NULL_ID),
                            pa.array(o[:-1] + row["base"]),
                            pa.array(np.diff(o)),
                            pa.array(crc, pa.int64()),
                        ],
                        names=[key, "start", "n_tokens", "ids_crc32"],
                    )

    return spread.mapInArrow(read, f"{key} long, start long, n_tokens long, ids_crc32 long")


def token_table(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, drops_space: bool = False) -> DataFrame:
    """Write the files to the shared folder and return what they say."""
    folder = runtime.scratch(df.sparkSession, "tokens")
    manifest = write_token_files(df, key, text, tokenizer, end_id, folder, drops_space)
    return read_token_files(manifest, folder, key)
