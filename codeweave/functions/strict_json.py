"""JSON out of a model's reply: fences stripped, unknown keys ignored, everything else strict.

``from_json`` forgives what must be an error here (wrong types, trailing text), so this runs in
Python; ``replies`` parses a whole table of replies in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

_FENCE = re.compile(r"```(?:json)?(.*)```", re.DOTALL)


class ReplyError(ValueError):
    """The reply is not the JSON document that was asked for."""


def unfence(text: str) -> str:
    """What stands between the first and the last fence, or the whole text."""
    found = _FENCE.search(text)
    return (found.group(1) if found else text).strip()


def _fit(value: Any, shape: Any, at: str) -> Any:
    if isinstance(shape, list):
        if value is None:
            return []
        if not isinstance(value, list):
            raise ReplyError(f"{at}: expected an array")
        return [_fit(x, shape[0], f"{at}[{i}]") for i, x in enumerate(value)]
    if isinstance(shape, dict):
        if value is None:
            value = {}
        if not isinstance(value, dict):
            raise ReplyError(f"{at}: expected an object")
        folded = {k.lower(): v for k, v in value.items()} | dict(value)
        return {k: _fit(folded.get(k, folded.get(k.lower())), s, f"{at}.{k}") for k, s in shape.items()}
    if value is None:
        return shape()
    if shape is int and isinstance(value, bool) or not isinstance(value, shape):
        raise ReplyError(f"{at}: expected {shape.__name__}")
    return value


def parse_reply(text: str, shape: Any) -> Any:
    """Parse ``text`` into ``shape``: nested dicts of field shapes, [element shape], or str, bool, int.

    Keys match without regard to case, missing fields get their zero value, others are dropped.
    """
    try:
        value = json.loads(unfence(text))
    except json.JSONDecodeError as e:
        raise ReplyError(str(e)) from e
    return _fit(value, shape, "$")


def replies(df: DataFrame, key: str, reply: str, shape: Any, kind: str) -> DataFrame:
    """(key, value, problem) of every row: the reply as the Spark struct ``kind``, or what is wrong with it."""
    rows = df.select(df[key].alias("key"), df[reply].alias("reply"))
    out = f"key {rows.schema['key'].dataType.simpleString()}, value {kind}, problem string"
    value = to_arrow_type(df.sparkSession.createDataFrame([], out).schema["value"].dataType)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[Any, str | None]] = []
            for text in batch.column("reply").to_pylist():
                try:
                    found.append((parse_reply(text or "", shape), None))
                except ReplyError as e:
                    found.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([v for v, _ in found], value), pa.array([p for _, p in found], pa.string())], names=["key", "value", "problem"])

    return rows.mapInArrow(parse, out).withColumnRenamed("key", key)
