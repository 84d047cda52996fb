"""The access-log table: schema, and the adapter from the ``events`` test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = (
    "site_id string, id long, ip string, pageview_flag int, timestamp long, method string, url string, status_code int, bytes_sent long, "
    "request_length long, request_time_ms long, upstream_response_time_ms long, upstream_addr string, host string, request_id string, "
    "fingerprint string, referer string, browser string, os string, device string, domestic string, global string"
)

_K = "cast(get_json_object(props, '$.k') as bigint)"


def hits(events: DataFrame) -> DataFrame:
    """Hits from the events table, page-view flag included (status 200, outside 10.*, not .css)."""
    e = events.selectExpr("*", f"{_K} as k").selectExpr(
        "event_id as id",
        "'site' as site_id",
        "unix_timestamp(cast(ts as timestamp)) as timestamp",
        "concat(case when user_id % 11 = 0 then '10.0.' else '203.0.' end, cast(user_id div 250 as string), '.', cast(user_id % 250 + 1 as string)) as ip",
        "case when event_type in ('signup','purchase') then 'POST' else 'GET' end as method",
        "concat('/', event_type, '/', cast(k % 20 as string), case when k % 7 = 0 then '.css' else '' end) as url",
        "case when event_type = 'error' then case when k % 3 = 0 then 500 when k % 3 = 1 then 404 else 503 end "
        "when k % 13 = 0 then 302 when k % 17 = 0 then 101 else 200 end as status_code",
        "cast(floor(value * 100) as bigint) as bytes_sent",
        "cast(k * 8 as bigint) as request_length",
        "cast(floor(value * 10) as bigint) as request_time_ms",
        "cast(case when k % 4 = 0 then 0 else floor(value * 7) end as bigint) as upstream_response_time_ms",
        "case when k % 4 = 0 then '' else concat('10.1.0.', cast(k % 5 + 1 as string), ':8080') end as upstream_addr",
        "case k % 4 when 0 then 'example.com' when 1 then 'www.example.com' when 2 then 'other.test' else '' end as host",
        "concat('req-', cast(event_id as string)) as request_id",
        "case k % 6 when 0 then '-' when 1 then '' when 2 then 'https://www.google.com/search' when 3 then 'https://cn.bing.com/' "
        "when 4 then 'https://example.com/home' else concat('https://ref', cast(k % 9 as string), '.test/') end as referer",
        "case user_id % 4 when 0 then 'Chrome' when 1 then 'Safari' when 2 then 'Firefox' else 'bot' end as browser",
        "case user_id % 4 when 0 then 'Windows' when 1 then 'iOS' when 2 then 'Android' else 'bot' end as os",
        "case user_id % 4 when 0 then 'desktop' when 1 then 'mobile' when 2 then 'tablet' else 'bot' end as device",
        "case user_id % 5 when 0 then 'Guangdong·Shenzhen' when 1 then 'Zhejiang·Hangzhou' when 2 then 'Beijing' when 3 then 'pending' else 'Japan·Tokyo' end as domestic",
        "case user_id % 5 when 3 then 'pending' when 4 then 'Japan' else 'China' end as global",
    )
    return e.withColumn(
        "pageview_flag", (F.col("status_code") == 200).cast("int") * (~F.col("ip").startswith("10.")).cast("int") * (~F.col("url").endswith(".css")).cast("int")
    )


def load_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/events.parquet"))
