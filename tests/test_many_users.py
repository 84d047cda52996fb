"""Access-log queries on hits of more users than two octets of their addresses hold."""

import duckdb
import pytest
from test_oracle import QUERIES, SF, SQL, rows

NAMES = [
    "flag_default_paths", "geo_apply", "geo_apply_sessions", "geo_choose", "geo_drop_failures", "geo_effective", "geo_locate", "geo_pending", "geo_resolve", "geo_resolve_failures",
    "geo_trim_cache", "geo_upsert_cache", "pageview_flag",
]


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    at = tmp_path_factory.mktemp("many")
    shifted = f"SELECT * REPLACE (user_id + n * 64000 AS user_id, event_id + n * 1000 AS event_id) FROM '{SF}/events.parquet', range(3) t(n)"
    duckdb.sql(f"COPY (SELECT * EXCLUDE (n) FROM ({shifted})) TO '{at}/events.parquet'")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_many_users(spark, many, name):
    df = QUERIES[name](spark, many)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{many}/events.parquet'")
    want = duckdb.sql(SQL[name])
    assert got == rows(want.columns, want.fetchall())
