"""Source trees as tables: a Python data source over a directory, and revisions of a git work tree.

Spark's file sources leave out names that start with '.' or '_'; this one returns every file.  The
driver lists the tree and deals its files into partitions by size; executors read the contents.  So
the tree has to be at a path that all of them mount, or at an address of an object store (``s3://`` and what
else Arrow's file systems open).  Globs of the ``exclude`` option (one a
line) are applied before anything is read, and directories that ``/**`` covers are not entered.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeweave.functions.globs import excluder, pruned_dirs

PART_BYTES = 8 << 20


class MissingRevision(ValueError):
    """The head revision does not exist."""


def _remote(root: str):
    """(file system, path) of an address; None of a mounted path."""
    scheme, mark, rest = root.partition("://")
    if not mark:
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else root)


def listing(root: str, exclude: Sequence[str] = ()) -> list[tuple[str, int]]:
    """(path below root with '/', size) of every regular file, in bytewise order."""
    excluded, pruned = excluder(exclude), pruned_dirs(exclude)
    out = []
    if far := _remote(root):
        from pyarrow import fs

        system, top = far
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        files = [(f.path[len(top.rstrip("/")) + 1 :], f.size) for f in found if f.type == fs.FileType.File]
        return sorted(((p, n) for p, n in files if not excluded(p)), key=lambda x: x[0].encode())
    for folder, dirs, names in os.walk(root):
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if below == "." else below + "/"
        dirs[:] = sorted(d for d in dirs if not any(p.fullmatch(prefix + d) for p in pruned))
        for name in names:
            path = prefix + name
            full = os.path.join(folder, name)
            if not excluded(path) and os.path.isfile(full):
                out.append((path, os.path.getsize(full)))
    return sorted(out, key=lambda x: x[0].encode())


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(0)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, exclude: list[str], contents: bool) -> None:
        self.root, self.exclude, self.contents = root, exclude, contents

    def partitions(self) -> Sequence[InputPartition]:
        parts, size = [[]], 0
        for path, n in listing(self.root, self.exclude):
            if parts[-1] and size + n > PART_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        far = _remote(self.root) if self.contents else None
        for path in partition.paths:
            if far:
                with far[0].open_input_stream(f"{far[1].rstrip('/')}/{path}") as f:
                    yield path, f.read()
            elif self.contents:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield path, f.read()
            else:
                yield path, None


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(root)``: path, content."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        globs = [g for g in self.options.get("exclude", "").split("\n") if g]
        return _Reader(self.options["path"], globs, self.options.get("contents", "true") == "true")


def read_tree(spark: SparkSession, root: str, exclude: Sequence[str] = (), contents: bool = True) -> DataFrame:
    """(path, content) of every file below ``root`` that no glob excludes."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("exclude", "\n".join(exclude)).option("contents", str(contents).lower()).load(root)


def module_name(root: str, file: str = "go.mod") -> str:
    """The module's name from its declaration file; a missing or unreadable one is an error."""
    with open(os.path.join(root, file), encoding="utf-8") as f:
        for line in f:
            words = line.split("//")[0].split()
            if len(words) == 2 and words[0] == "module":
                return words[1].strip('"')
    raise ValueError(f"{file} declares no module")


def snapshot(files: DataFrame) -> DataFrame:
    """(path, content_hash) of (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("content_hash"))


def _git(root: str, *args: str, told: bytes | None = None) -> bytes | None:
    got = subprocess.run(["git", "-C", root, *args], capture_output=True, input=told)
    return got.stdout if got.returncode == 0 else None


def _listing(root: str, name: str, base: bool) -> dict[str, str]:
    """path -> git's content hash of a committed revision."""
    commit = _git(root, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}")
    if commit is None:
        if base:
            return {}
        raise MissingRevision(name)
    entries = (_git(root, "ls-tree", "-r", "-z", commit.decode().strip()) or b"").split(b"\0")
    split = [e.partition(b"\t") for e in entries if e]
    return {path.decode("utf-8", "replace"): meta.split()[2].decode() for meta, _, path in split}


def _blobs(root: str, hashes: set[str]) -> dict[str, str]:
    """Contents by hash, read by one process."""
    order, out, at = sorted(hashes), {}, 0
    told = _git(root, "cat-file", "--batch", told="".join(h + "\n" for h in order).encode()) or b""
    for h in order:
        end = told.index(b"\n", at)
        head = told[at:end].split()
        size = int(head[2]) if len(head) == 3 else 0  # else it is missing, as a submodule's is
        if len(head) == 3 and head[1] == b"blob":
            out[h] = told[end + 1 : end + 1 + size].decode("utf-8", "replace")
        at = end + 1 + (size + 1 if len(head) == 3 else 0)
    return out


def revision(spark: SparkSession, root: str, name: str, base: bool = False) -> DataFrame:
    """(path, content_hash) of a committed revision, with git's own content hashes.

    A base revision that does not exist is an empty tree; a missing head is an error.
    """
    return spark.createDataFrame(list(_listing(root, name, base).items()), "path string, content_hash string")


def revisions(spark: SparkSession, root: str, base: str = "", head: str = "") -> tuple[DataFrame, DataFrame]:
    """The two snapshots of a diff, (path, content_hash, content); blank names are ``HEAD~1`` and ``HEAD``.

    Contents are those of files that only one side has, which may be moved ones; others are null.
    """
    old, new = _listing(root, base or "HEAD~1", True), _listing(root, head or "HEAD", False)
    alone = [{p: h for p, h in a.items() if p not in b} for a, b in ((old, new), (new, old))]
    text = _blobs(root, set(alone[0].values()) ^ set(alone[1].values())) if all(alone) else {}
    schema = "path string, content_hash string, content string"
    return tuple(spark.createDataFrame([(p, h, text.get(h) if p in own else None) for p, h in side.items()], schema) for side, own in zip((old, new), alone))
