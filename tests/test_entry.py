"""Every registered query with SQL against DuckDB over the smallest tables, and the driver's contract."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else f"{round(value, 6) + 0.0:.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list):
        return [plain(v) for v in value]
    return "null" if value is None else value if isinstance(value, (str, bool)) else f"{float(value):.6f}"


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
