"""Each access-log query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from hitlake.plans import queries as plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = duckdb.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
