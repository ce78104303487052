"""Every registered query with an oracle matches DuckDB on sf0.001 (exact values)."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from opsledger.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    s_cols, s_rows = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.sql(entry.oracle_sql()[name])
    o_cols, o_rows = rows(res.columns, res.fetchall())
    assert s_cols == o_cols
    assert s_rows == o_rows


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "dispatched_quantity_mt" in df.columns
