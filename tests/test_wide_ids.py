"""Access-log queries on hits of users whose addresses leave their net."""

import duckdb
import pytest
from test_oracle import QUERIES, SF, SQL, rows

NAMES = ["flag_default_paths", "geo_apply", "geo_choose", "geo_locate", "pageview_flag"]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    at = tmp_path_factory.mktemp("wide")
    shifted = f"SELECT * REPLACE (user_id + n * 16384000 AS user_id, event_id + n * 1000 AS event_id) FROM '{SF}/events.parquet', range(4) t(n)"
    duckdb.sql(f"COPY (SELECT * EXCLUDE (n) FROM ({shifted})) TO '{at}/events.parquet'")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_wide_ids(spark, wide, name):
    df = QUERIES[name](spark, wide)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{wide}/events.parquet'")
    want = duckdb.sql(SQL[name])
    assert got == rows(want.columns, want.fetchall())
