"""The artifacts that stages hand to each other, as canonical JSON documents.

Canonical means: keys sorted, two spaces of indent, written beside the target and renamed over it, so
equal tables give equal bytes and a reader never sees half a file.  These documents describe one
repository and go through the driver; tables of any size are kept as Parquet instead.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import schema
from codeweave.operators.resolve import stored

#: File names of the artifacts.
FILE_INDEX = "file_index.json"
DEP_GRAPH = "dep_graph.json"
NAV_PLAN = "nav_plan.json"
SHARED_CONTEXT = "shared_context.json"
VALIDATION_REPORT = "validation_report.json"
MODULE_DOCS = "module_docs"


class ArtifactNotFound(FileNotFoundError):
    """The artifact was not written yet; callers decide by this what to run."""


def write_json(path: str, value: Any, sort_keys: bool = True) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, ensure_ascii=False, sort_keys=sort_keys)
            f.write("\n")
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def read_json(path: str) -> Any:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError as e:
        raise ArtifactNotFound(path) from e


def _plain(value: Any) -> Any:
    """Rows as dicts; arrays are never null."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


class Artifacts:
    """Reads and writes the artifacts of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def has(self, name: str) -> bool:
        return os.path.exists(self.path(name))

    def write_file_index(self, index: DataFrame) -> None:
        rows = stored(index).toLocalIterator()
        entries = {r["path"]: {k: v for k, v in _plain(r).items() if k != "path"} for r in rows}
        # Fields of an entry keep the order of the data model; only paths are sorted.
        write_json(self.path(FILE_INDEX), dict(sorted(entries.items())), sort_keys=False)

    def read_file_index(self) -> DataFrame:
        found = read_json(self.path(FILE_INDEX))
        rows = [(p, e["language"], e["content_hash"], e["functions"] or [], e["types"] or [], [{**i, "resolved_path": ""} for i in e["imports"] or []]) for p, e in found.items()]
        return self.spark.createDataFrame(rows, schema.FILE_INDEX)

    def read_file_index_distributed(self) -> DataFrame:
        """The same table through Spark's own JSON reader, for documents beyond the driver."""
        if not self.has(FILE_INDEX):
            raise ArtifactNotFound(self.path(FILE_INDEX))
        lines = self.spark.read.text(self.path(FILE_INDEX), wholetext=True)
        entries = lines.select(F.explode(F.from_json("value", f"map<string,{schema.STORED_ENTRY}>")).alias("path", "e")).select("path", "e.*")
        return entries.withColumn("imports", F.transform("imports", lambda i: F.struct(i["path"].alias("path"), i["internal"].alias("internal"), F.lit("").alias("resolved_path"))))

    def write_dep_graph(self, lists: DataFrame) -> None:
        write_json(self.path(DEP_GRAPH), {r["path"]: list(r["deps"]) for r in lists.toLocalIterator()})

    def read_dep_graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges)."""
        found = read_json(self.path(DEP_GRAPH))
        nodes = self.spark.createDataFrame([(p,) for p in found], schema.NODES)
        return nodes, self.spark.createDataFrame([(p, d) for p, deps in found.items() for d in deps or []], schema.EDGES)

    def write_nav_plan(self, modules: list[dict], generated_at: str) -> None:
        kept = []
        for m in modules:
            m = {k: v for k, v in m.items() if k != "pos"}
            kept.append({k: v for k, v in m.items() if v or k not in ("depends_on_shared", "referenced_by")})
        write_json(self.path(NAV_PLAN), {"generated_at": generated_at, "modules": kept}, sort_keys=False)

    def read_nav_plan(self) -> DataFrame:
        return modules_frame(self.spark, read_json(self.path(NAV_PLAN))["modules"])

    def write_shared_context(self, context: DataFrame) -> None:
        rows = {r["module_id"]: {k: v for k, v in _plain(r).items() if k != "module_id"} for r in context.toLocalIterator()}
        write_json(self.path(SHARED_CONTEXT), dict(sorted(rows.items())), sort_keys=False)

    def read_shared_context(self) -> DataFrame:
        found = read_json(self.path(SHARED_CONTEXT))
        rows = [(m, s["summary"], s["key_types"] or [], s["key_functions"] or [], s["source_refs"] or []) for m, s in found.items()]
        return self.spark.createDataFrame(rows, schema.SHARED_CONTEXT)

    def write_report(self, gone: DataFrame, totals: DataFrame, generated_at: str) -> dict:
        t = totals.first()
        rows = [_plain(r) for r in gone.select("source_file", "link_text", "link_target", "line").orderBy("source_file", "link_target", "link_text").toLocalIterator()]
        # An empty list is null in this one document.
        value = {"broken_links": rows or None, "total_links": t["total_links"], "total_files": t["total_files"], "generated_at": generated_at}
        write_json(self.path(VALIDATION_REPORT), value, sort_keys=False)
        return value

    def write_module_docs(self, docs: DataFrame) -> list[str]:
        """One file per module that has content; returns the ids written."""
        return write_texts(docs.where("content is not null").select(F.concat("module_id", F.lit(".md")).alias("path"), "content"), self.path(MODULE_DOCS))

    def read_module_docs(self) -> DataFrame:
        folder = self.path(MODULE_DOCS)
        rows = []
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            if name.endswith(".md"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    rows.append((name[:-3], f.read()))
        return self.spark.createDataFrame(rows, "module_id string, content string")


def modules_frame(spark: SparkSession, modules: list[dict]) -> DataFrame:
    rows = [
        (m["id"], i, m.get("files") or [], bool(m.get("shared")), m.get("owner") or "", m.get("depends_on_shared") or [], m.get("referenced_by") or [])
        for i, m in enumerate(modules)
    ]
    return spark.createDataFrame(rows, schema.MODULES)


def write_texts(docs: DataFrame, folder: str) -> list[str]:
    """Files of (path, content) below ``folder``, streamed through the driver; returns their paths."""
    out = []
    for r in docs.select("path", "content").toLocalIterator():
        full = os.path.join(folder, r["path"])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(r["content"])
        out.append(r["path"])
    return sorted(out)
