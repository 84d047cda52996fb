"""Time ranges for reports (driver side, ``now`` always given) and labelled spines."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def named_range(name: str, now: datetime, exact: bool = True) -> tuple[datetime, datetime]:
    """[start, end) of a named range; ``exact=False`` ends a second early (week and month: an hour)."""
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    one = timedelta(days=1)
    lost = timedelta(0) if exact else timedelta(seconds=1)
    if name == "yesterday":
        return today - one, today - lost
    if name == "week":
        first = today - timedelta(days=today.weekday())
        return first, first + 7 * one - (timedelta(0) if exact else timedelta(hours=1))
    if name == "month":
        first = today.replace(day=1)
        return first, (first + 32 * one).replace(day=1) - (timedelta(0) if exact else timedelta(hours=1))
    if name in ("last7days", "last30days"):
        return today - (int(name[4:-4]) - 1) * one, today + one - lost
    try:
        d = datetime.strptime(name, "%Y-%m-%d").replace(tzinfo=now.tzinfo)
        return d, d + one - lost
    except ValueError:
        return today, today + one - lost


def previous_range(name: str, now: datetime, exact: bool = True) -> tuple[datetime, datetime]:
    """The range that a named range is compared with: the day, seven or thirty days, week or calendar month before it."""
    start, end = named_range(name, now, exact)
    if name == "month":
        first = (start - timedelta(days=1)).replace(day=1)
        return first, start - (timedelta(0) if exact else timedelta(seconds=1))
    days = {"week": 7, "last7days": 7, "last30days": 30}.get(name, 1)
    return start - timedelta(days=days), end - timedelta(days=days)


def flexible_time(text: str, tz=None) -> datetime | None:
    """Epoch seconds or milliseconds, RFC 3339, or local date and time."""
    if text.isdigit():
        n = int(text)
        return datetime.fromtimestamp(n / 1000 if n > 10**12 else n, tz)
    for layout in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, layout).replace(tzinfo=tz)
        except ValueError:
            pass
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        return None


def intersect(a: tuple[int, int], start: int | None, end: int | None) -> tuple[int, int]:
    return max(a[0], start if start is not None else a[0]), min(a[1], end if end is not None else a[1])


def labels(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """Buckets with labels: hour of the day, or the date; and the day of the week."""
    s = spark.range(start, end, step).select(F.col("id").alias("bucket"))
    t = F.timestamp_seconds("bucket")
    return s.withColumn("label", F.date_format(t, "HH:mm" if step < 86400 else "yyyy-MM-dd")).withColumn("weekday", F.date_format(t, "EEEE"))
