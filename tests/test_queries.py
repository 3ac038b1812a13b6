"""Every registered query with check SQL gives the same rows on DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="test tables are not there")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def cell(value):
    import pandas as pd

    if value is None or pd.isna(value):
        return "-"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "year"):
        return str(pd.Timestamp(value))
    try:
        return repr(float(value))
    except (TypeError, ValueError):
        return str(value)


def table_of(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, row)) for row in df.itertuples(index=False))


QUERIES = contract.queries()
CHECKS = contract.oracle_sql()


def test_contract_names():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, duck, name):
    got = table_of(QUERIES[name](spark, str(SMALL)).toPandas())
    assert got == table_of(duck.sql(CHECKS[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, str(SMALL)).collect()


def test_entry(spark):
    assert contract.entry(spark).count() > 0
