"""Every registered query with SQL against DuckDB over the same small tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return bool(x)
    return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


def _rows(df):
    return sorted((tuple(_plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, small, name):
    got, want = entry.queries()[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() >= 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())
