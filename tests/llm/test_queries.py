import os

import duckdb
import pytest

import __spark_entry__ as entry
from codeweave.llm import oracle, queries


@pytest.fixture(scope="module")
def duck(sf01):
    con = duckdb.connect()
    for f in os.listdir(sf01):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf01}/{f}'")
    return con


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_query_against_its_sql(spark, sf01, duck, name):
    df = queries.queries()[name](spark, sf01)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    found = duck.execute(oracle.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols and got == sorted(repr(tuple(dict(zip(names, row))[c] for c in cols)) for row in found.fetchall())


def test_registered_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(oracle.SQL) <= set(entry.oracle_sql())
