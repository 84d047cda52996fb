"""Roll-ups, visitor sets, first seen, dimensions, loads and retention, by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basics import day, hour, pv, status_counts
from .sessions import agg_entry_daily, agg_session_daily, session_state, sessionize

_COUNTS = ["pv", "traffic", "s2xx", "s3xx", "s4xx", "s5xx", "other"]
DIMENSIONS = {"ip": ["ip"], "url": ["url"], "referer": ["referer"], "ua": ["browser", "os", "device"], "location": ["domestic", "global"]}


def _rollup(log: DataFrame, bucket) -> DataFrame:
    return log.groupBy("site_id", bucket).agg(
        F.count_if(pv()).alias("pv"), F.sum(F.when(pv(), F.col("bytes_sent")).otherwise(0)).alias("traffic"), *status_counts()
    )


def agg_hourly(log: DataFrame) -> DataFrame:
    return _rollup(log, hour().alias("bucket"))


def agg_daily(log: DataFrame) -> DataFrame:
    return _rollup(log, day().alias("day"))


def agg_hourly_ip(log: DataFrame) -> DataFrame:
    return log.where(pv()).select("site_id", hour().alias("bucket"), "ip").distinct()


def agg_daily_ip(log: DataFrame) -> DataFrame:
    return log.where(pv()).select("site_id", day().alias("day"), "ip").distinct()


def first_seen(log: DataFrame) -> DataFrame:
    return log.where(pv()).groupBy("site_id", "ip").agg(F.min("timestamp").alias("first_ts"))


def number_visitors(log: DataFrame, path: str, known: DataFrame | None = None) -> DataFrame:
    """Addresses (ip, number) of page views, written to ``path`` and read back: numbers that bitmaps can hold.

    A task numbers its addresses one after the other from a start of its own, so their
    bits lie close together; with ``known`` only new addresses are numbered, behind all known ones.
    """
    new = log.where(pv()).select("ip").where("ip is not null").distinct()
    if known is not None:
        new = new.join(known.select("ip"), "ip", "left_anti")
    start = 0 if known is None else (known.agg(F.max("number")).first()[0] or 0) + 1
    new.withColumn("number", F.monotonically_increasing_id() + start).write.mode("append").parquet(path)
    return log.sparkSession.read.schema("ip string, number long").parquet(path)


def visitor_bitmaps(log: DataFrame, numbers: DataFrame, bucket: Column) -> DataFrame:
    """Visitors of each (site, bucket) as bitmaps of 32768 numbers: (site_id, bucket, block, visitors)."""
    n = log.where(pv()).select("site_id", bucket.alias("bucket"), "ip").join(numbers, "ip")
    g = n.groupBy("site_id", "bucket", F.bitmap_bucket_number("number").alias("block"))
    return g.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("visitors"))


def merge_bitmaps(bitmaps: DataFrame, *keys: str | Column) -> DataFrame:
    """Bitmaps of several buckets or loads as one by ``keys`` (none: all): sets unite by OR."""
    return bitmaps.groupBy(*keys, "block").agg(F.bitmap_or_agg("visitors").alias("visitors"))


def count_visitors(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """UV of merged bitmaps by ``keys``: exact, and of any range of buckets."""
    return bitmaps.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("visitors")), F.lit(0)).alias("uv"))


def merge_counts(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of counters: equal keys add."""
    values = [c for c in base.columns if c not in keys]
    return base.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def merge_first_seen(base: DataFrame, delta: DataFrame) -> DataFrame:
    return base.unionByName(delta).groupBy("site_id", "ip").agg(F.min("first_ts").alias("first_ts"))


def dim_id(name: str) -> Column:
    """Hash of a dimension's natural key; a null is told from nothing, so (null, x) and (x, null) differ."""
    return F.xxhash64(F.lit(name), *[x for c in DIMENSIONS[name] for x in (F.col(c).isNull(), F.col(c))])


def build_dims(log: DataFrame) -> dict[str, DataFrame]:
    """Five dimensions; ids are hashes of the natural key, so they need no sequence."""
    return {k: log.select(*c).distinct().withColumn(f"{k}_id", dim_id(k)) for k, c in DIMENSIONS.items()}


def encode_fact(log: DataFrame) -> DataFrame:
    """Hits with ids in place of dimension columns; an id is a hash of its natural key, so no join is needed."""
    out = log
    for k in DIMENSIONS:
        out = out.withColumn(f"{k}_id", dim_id(k))
    return out.drop(*{x for c in DIMENSIONS.values() for x in c})


def decode_fact(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    out = fact
    for k in DIMENSIONS:
        out = out.join(dims[k], f"{k}_id").drop(f"{k}_id")
    return out


def prune_dims(dim: DataFrame, key: str, refs: list[tuple[DataFrame, str]]) -> DataFrame:
    """Drop dimension rows that no table refers to (anti joins: a null reference blocks nothing)."""
    used = None
    for df, c in refs:
        one = df.select(F.col(c).alias(key)).where(F.col(key).isNotNull()).distinct()
        used = one if used is None else used.unionByName(one).distinct()
    return dim.join(used, key, "left_semi")


def dedup_new(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Idempotent load: unique (site, timestamp, fingerprint); rows without fingerprint never conflict."""
    key = ["site_id", "timestamp", "fingerprint"]
    keyed = new.where("fingerprint is not null").dropDuplicates(key)
    fresh = keyed.join(existing.select(*key), key, "left_anti")
    return fresh.select(new.columns).unionByName(new.where("fingerprint is null"))


def replace_range(log: DataFrame, new: DataFrame, start: int, end: int) -> DataFrame:
    """Hits of [start, end) are replaced by ``new``."""
    t = F.col("timestamp")
    return log.where((t < start) | (t >= end)).unionByName(new.where((t >= start) & (t < end)))


def rebuild(log: DataFrame) -> dict[str, DataFrame]:
    """Everything that is derived from hits."""
    s = sessionize(log)
    return {
        "agg_hourly": agg_hourly(log), "agg_daily": agg_daily(log), "agg_hourly_ip": agg_hourly_ip(log), "agg_daily_ip": agg_daily_ip(log), "first_seen": first_seen(log),
        "sessions": s, "session_state": session_state(s), "agg_session_daily": agg_session_daily(s), "agg_entry_daily": agg_entry_daily(s),
    }


def apply_retention(log: DataFrame, sessions: DataFrame, cutoff: int) -> dict[str, DataFrame]:
    """Drop what is older than cutoff and rebuild from what remains; boundary buckets come out right."""
    kept = log.where(F.col("timestamp") >= cutoff)
    return {
        "log": kept, "agg_hourly": agg_hourly(kept), "agg_daily": agg_daily(kept), "agg_hourly_ip": agg_hourly_ip(kept),
        "agg_daily_ip": agg_daily_ip(kept), "first_seen": first_seen(kept), "sessions": sessions.where(F.col("start_ts") >= cutoff),
    }


def clear_site(log: DataFrame, site: str | None = None) -> DataFrame:
    return log.limit(0) if site is None else log.where(~F.col("site_id").eqNullSafe(F.lit(site)))


def split_recent(log: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    return log.where(F.col("timestamp") >= cutoff), log.where(F.col("timestamp") < cutoff)


def coverage(log: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Per site: first and last hit loaded, hours loaded, and first and last time in the logs.

    ``seen`` (site_id, timestamp) are all lines that have a time, loaded or not; the
    loaded hits where it is not given.
    """
    own = log.groupBy("site_id").agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"), F.count_distinct(hour()).alias("hours"))
    if seen is None:
        return own.withColumn("log_min_ts", F.col("min_ts")).withColumn("log_max_ts", F.col("max_ts"))
    there = seen.groupBy("site_id").agg(F.min("timestamp").alias("log_min_ts"), F.max("timestamp").alias("log_max_ts"))
    return there.join(own, "site_id", "left").select("site_id", "min_ts", "max_ts", F.coalesce("hours", F.lit(0)).alias("hours"), "log_min_ts", "log_max_ts")


def hours_of(log: DataFrame, start: int, end: int) -> DataFrame:
    s = log.sparkSession.range(start - start % 3600, end, 3600).select(F.col("id").alias("bucket"))
    have = log.select(hour().alias("bucket")).distinct().withColumn("loaded", F.lit(1))
    return s.join(have, "bucket", "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))


def missing_range(log: DataFrame, start: int, end: int) -> DataFrame:
    h = hours_of(log, start, end).where("loaded = 0")
    return h.agg(F.min("bucket").alias("missing_from"), (F.max("bucket") + 3600).alias("missing_to"), F.count("*").alias("missing_hours"))


def loaded_percent(log: DataFrame, start: int, end: int) -> DataFrame:
    h = hours_of(log, start, end).agg(F.sum("loaded").alias("l"), F.count("*").alias("n"))
    return h.selectExpr("l as loaded_hours", "n as hours", "least(100, greatest(0, l * 100 div greatest(n, 1))) as percent")


def totals(daily: DataFrame, daily_ip: DataFrame, d1: str, d2: str) -> DataFrame:
    """PV, UV and traffic from roll-ups, days d1 to d2 inclusive; UV from the visitor sets."""
    a = daily.where(F.col("day").between(F.lit(d1).cast("date"), F.lit(d2).cast("date"))).agg(
        F.coalesce(F.sum("pv"), F.lit(0)).alias("pv"), F.coalesce(F.sum("traffic"), F.lit(0)).alias("traffic")
    )
    u = daily_ip.where(F.col("day").between(F.lit(d1).cast("date"), F.lit(d2).cast("date"))).agg(F.count_distinct("ip").alias("uv"))
    return a.join(F.broadcast(u))  # one row each


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
