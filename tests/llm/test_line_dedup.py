import hashlib
from collections import Counter

import duckdb
import pytest

from codeweave.llm import line_dedup, oracle, queries

from .conftest import frame, messy_rows

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(FOLD)


def brute(rows, threshold, least=1):
    split = [(t or "").split("\n") for _, t in rows]
    seen = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= least)
    out = []
    for (i, _), lines in zip(rows, split):
        kept = [x for x in lines if len(key(x)) < least or seen[key(x)] < threshold]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_table_against_sql(spark, sf01):
    got = sorted(tuple(r) for r in queries.op3_line_dedup(spark, sf01).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf01}/documents.parquet'")
    assert got == sorted(con.execute(oracle.LINE_DEDUP).fetchall())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == brute(rows, 10) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("threshold, least", [(2, 1), (3, 0), (4, 5)])
def test_messy(messy, threshold, least):
    got = sorted((tuple(r) for r in line_dedup.line_report(messy, "doc_id", "text", threshold, least).collect()), key=repr)
    assert got == brute(messy_rows(), threshold, least)


def test_one_line_in_a_third_of_all_rows(spark):
    rows = [(i, f"Hot line\nown {i}\n" + ("pair\n" * (i % 2))) for i in range(900)]
    got = sorted((tuple(r) for r in line_dedup.line_report(frame(spark, rows), "doc_id", "text", 10).collect()), key=repr)
    assert got == brute(rows, 10)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (7, 3)])
def test_runs_count_alike_however_batches_arrive(spark, batches, fanout):
    rows = [(i, "\n".join(f"line {j}" for j in range(1, 13) if i % j == 0)) for i in range(60)]
    out = line_dedup.drop_common_lines(frame(spark, rows), "doc_id", "text", 10, batches=batches, fanout=fanout)
    got = sorted(((r["row"]["doc_id"], list(r["dropped"])) for r in out.collect()))
    seen = Counter(x for _, t in rows for x in set(t.split("\n")))
    assert got == [(i, [p for p, x in enumerate(t.split("\n")) if seen[x] >= 10]) for i, t in rows]


def test_rows_keep_their_columns(messy, nothing):
    out = line_dedup.drop_common_lines(messy, "doc_id", "text", 2)
    assert out.select("row.*").columns == messy.columns
    assert line_dedup.line_report(nothing, "doc_id", "text", 10).count() == 0
