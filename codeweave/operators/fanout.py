"""Completions for many independent requests, with errors as data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.operators.schema import MODULE_DOCS
from codeweave.sources.client import Client, Request, classify


class FanOutError(RuntimeError):
    """Some requests failed; ``failed`` has (id, message) in the order of arrival."""

    def __init__(self, total: int, failed: list[tuple[str, str]]) -> None:
        self.total, self.failed = total, failed
        ids = ", ".join(sorted(m for m, _ in failed))
        super().__init__(f"{len(failed)} of {total} modules failed: [{ids}]")

    def __reduce__(self):
        return FanOutError, (self.total, self.failed)

    def summary(self) -> str:
        return summary(self.total, self.failed)


def summary(total: int, failed: list[tuple[str, str]]) -> str:
    head = f"{total - len(failed)}/{total} modules documented"
    return "\n".join([head, *(["Failed modules:"] if failed else []), *(f"  - {m}: {text}" for m, text in failed)])


def complete(requests: DataFrame, client: Client, concurrency: int) -> DataFrame:
    """(module_id, content, error) of every request (module_id, model, system, user, max_tokens, temperature).

    At most ``concurrency`` requests run at a time: they are dealt over as many partitions, each of
    which asks one after the other.  A failure is a row of its own and stops nothing else.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    text = client.complete(Request(r.user, r.model or "", r.system or "", int(r.max_tokens or 0), float(r.temperature or 0)))
                    rows.append((r.module_id, text, None))
                except Exception as e:
                    e = classify(e)
                    rows.append((r.module_id, None, {"status": e.status, "message": e.message, "retryable": e.retryable}))
            yield pd.DataFrame(rows, columns=["module_id", "content", "error"])

    return requests.repartition(max(1, concurrency), "module_id").mapInPandas(ask, MODULE_DOCS)


def run(requests: DataFrame, client: Client, concurrency: int) -> DataFrame:
    """As ``complete``, but asked once and kept: the replies are written to the shared folder, so a plan
    that is evaluated again does not ask again."""
    return runtime.stage(complete(requests, client, concurrency), "completions")


def tally(results: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed, failed_ids (sorted, joined)."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.col("module_id")))), ", ").alias("failed_ids"),
    )


def raise_failures(results: DataFrame) -> None:
    failed = [(r["module_id"], r["message"]) for r in results.where("error is not null").select("module_id", "error.message").toLocalIterator()]
    if failed:
        raise FanOutError(results.count(), failed)
