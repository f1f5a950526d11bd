"""Every query with SQL, on the smallest tables, against DuckDB."""

import pathlib

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as driver

ORACLES = driver.oracle_sql()


def norm(value):
    return f"{value + 0.0:.9g}" if isinstance(value, float) else repr(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in pathlib.Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(norm(row[i]) for i in order) for row in want.fetchall())
    assert sorted(tuple(norm(row[c]) for c in columns) for row in df.collect()) == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(driver.queries())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0
    assert "risk_score" in df.columns


@pytest.mark.parametrize("name", ["missing_linkage", "missing_clusters", "tukey_hsd", "shapiro_wilk"])
def test_statistics_without_sql_give_rows(spark, name):
    assert driver.queries()[name](spark, SMALL).count() > 0
