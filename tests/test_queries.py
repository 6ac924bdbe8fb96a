"""Every registered query against its SQL on the small tables; those without SQL give rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def table(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(str, map(cell, row))) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in fixtures.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert table(got) == table(want)
    else:
        assert len(got)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["asset", "hr"] and df.count() > 0


def test_keys_of_oracles_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
