"""Every registered query against its SQL counterpart, on the whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as spark_entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def printed(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(printed(row[c]) for c in columns) for row in df.collect())
    cursor = sql.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(printed(row[i]) for i in order) for row in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert "overall_confidence" in spark_entry.entry(spark).columns
