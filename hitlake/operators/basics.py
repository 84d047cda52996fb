"""Conditions and buckets shared by reports. Ranges are half-open epoch seconds [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 1800
SLOW_MS = 1000
PENDING, UNKNOWN, MAINLAND = "pending", "unknown", "China"
#: Substrings of search engines' referers (fixed values).
SEARCH_ENGINES = ["baidu.", "google.", "bing.", "sogou.", "360.", "so.com", "yahoo.", "duckduckgo.", "yandex."]


def bind(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a generator of one row: filters on them stay above it, and expressions that use them do not copy theirs."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def pv() -> Column:
    return F.col("pageview_flag") == 1


def in_range(start: int, end: int) -> Column:
    return (F.col("timestamp") >= start) & (F.col("timestamp") < end)


def url_filter(text: str | None, pattern: bool = False) -> Column:
    """Substring of the url; with ``pattern`` % and _ are wildcards."""
    if not text:
        return F.lit(True)
    if pattern:
        return F.col("url").like("%" + text.replace("\\", "\\\\") + "%")
    return F.col("url").contains(text)


def ts() -> Column:
    return F.timestamp_seconds(F.col("timestamp"))


def day() -> Column:
    return F.to_date(ts())


def hour() -> Column:
    """Start of the hour in the session time zone, as epoch seconds."""
    return F.unix_timestamp(F.date_trunc("hour", ts()))


def status_counts() -> list[Column]:
    s = F.col("status_code")
    one = [F.count_if((s >= k * 100) & (s < k * 100 + 100)).alias(f"s{k}xx") for k in (2, 3, 4, 5)]
    return [*one, F.count_if((s < 200) | (s >= 600)).alias("other")]


def uv(condition: Column | None = None) -> Column:
    ip = F.col("ip") if condition is None else F.when(condition, F.col("ip"))
    return F.count_distinct(ip)


def share(value: str, digits: int | None = None) -> Column:
    """Value over the frame's total; for frames already limited to a few rows."""
    total = F.sum(value).over(Window.partitionBy())
    r = F.when(total > 0, F.col(value) / total).otherwise(0.0)
    return r if digits is None else F.round(r, digits)


def spine(spark, start: int, end: int, step: int) -> DataFrame:
    """Buckets from start to end."""
    return spark.range(start, end, step).select(F.col("id").alias("bucket"))
