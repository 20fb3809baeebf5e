"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    return "0.0" if isinstance(v, float) and v == 0 else repr(v)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert len(columns) == len(set(columns))
    rows = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(_cell(r[i]) for i in at) for r in got.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
