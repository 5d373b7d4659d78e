import os

import duckdb
import pytest

import __spark_entry__ as entry
from codeweave.plans import oracle
from codeweave.plans import queries as plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_against_its_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    found = duck.execute(oracle.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(dict(zip(names, row))[c] for c in cols)) for row in found.fetchall())
    assert sorted(names) == cols and got == want


def test_contract_of_the_driver(spark):
    assert set(oracle.SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["source_file", "link_text", "link_target", "line"]


def test_every_query_has_sql():
    assert set(oracle.SQL) == set(plans.queries())
