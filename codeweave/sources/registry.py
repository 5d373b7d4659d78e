"""Language parsers by file extension, and the operator that applies them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions import text
from codeweave.operators.schema import ENTRY
from codeweave.sources import golang

Parser = Callable[[bytes], dict]


class Registry:
    """Extensions (with their dot, case-sensitive) and the parser of each."""

    def __init__(self) -> None:
        self._parsers: dict[str, Parser] = {}

    def register(self, extension: str, parser: Parser) -> None:
        if extension in self._parsers:
            raise ValueError(f"a parser for {extension} is registered already")
        self._parsers[extension] = parser

    def lookup(self, extension: str) -> Parser | None:
        return self._parsers.get(extension)

    @property
    def extensions(self) -> list[str]:
        return sorted(self._parsers)


def default_registry() -> Registry:
    out = Registry()
    out.register(".go", golang.parse)
    return out


def _shape(entry: dict) -> dict:
    for name, kind in (("functions", ("name", "signature")), ("types", ("name", "kind"))):
        entry[name] = [{k: d[k] for k in (*kind, "line_start", "line_end", "exported")} for d in entry[name]]
    return entry


def parse_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(path, entry, error) of the files (path, content) that have a parser; one of entry and error is null."""
    registry = registry or default_registry()
    known = files.where(text.extension(F.col("path")).isin(registry.extensions)).select("path", "content")
    fields = [("path", "string"), ("entry", ENTRY), ("error", "string")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join(f"{n} {t}" for n, t in fields)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    parser = registry.lookup("." + path.rpartition("/")[2].rpartition(".")[2])
                    rows.append({"path": path, "entry": _shape(parser(content or b"")), "error": None})
                except ValueError as e:
                    rows.append({"path": path, "entry": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return known.mapInArrow(run, ddl)


def index_of(parsed: DataFrame) -> DataFrame:
    """The file index: the files that were accepted."""
    return parsed.where("entry is not null").select("path", "entry.*")


def skipped(parsed: DataFrame) -> int:
    return parsed.where("error is not null").count()


