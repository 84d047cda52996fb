"""Sessions: page views of one (site, ip, browser, os, device) with gaps of at most ``gap`` seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basics import GAP, in_range, pv, url_filter

VISITOR = ["site_id", "ip", "browser", "os", "device"]
#: Seconds of a visitor's hits that are cut into sessions together.
CHUNK = 86400


def session_parts(log: DataFrame, gap: int = GAP, chunk: Column | None = None, keys: list[str] = VISITOR, sums: tuple[str, ...] = ()) -> DataFrame:
    """Sessions within chunks of time (``chunk``, a day by default): (keys, chunk, first and last hit's columns).

    A part needs only its own hits, so it can be stored by day and by load. With other
    ``keys`` than a visitor, all hits count and not page views alone; ``sums`` are added up.
    """
    w = Window.partitionBy(*keys, "chunk").orderBy("timestamp", "id")
    h = (log.where(pv()) if keys is VISITOR else log).withColumn("chunk", F.floor(F.col("timestamp") / CHUNK) if chunk is None else chunk)
    h = h.withColumn("new", (F.col("timestamp") - F.lag("timestamp").over(w) > gap).cast("int"))
    h = h.withColumn("no", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("timestamp", "id")
    return h.groupBy(*keys, "chunk", "no").agg(
        F.min_by("domestic", at).alias("domestic"), F.min_by("global", at).alias("global"), F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"), F.min_by("url", at).alias("entry_url"), F.max_by("url", at).alias("exit_url"), F.count("*").alias("page_count"),
        F.min_by("id", at).alias("start_id"), F.max_by("id", at).alias("end_id"), *[F.sum(c).alias(c) for c in sums],
    ).drop("no")


def merge_parts(parts: DataFrame, gap: int = GAP, keys: list[str] = VISITOR, sums: tuple[str, ...] = ()) -> DataFrame:
    """Whole sessions of parts: those of one visitor with gaps of at most ``gap`` are one.

    Parts may overlap, as those of loads with late hits do: inside a part no gap is longer.
    """
    w = Window.partitionBy(*keys).orderBy("start_ts", "start_id")
    before = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = parts.withColumn("new", (F.col("start_ts") - before > gap).cast("int"))
    p = p.withColumn("no", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.struct("start_ts", "start_id"), F.struct("end_ts", "end_id")
    return p.groupBy(*keys, "no").agg(
        F.min_by("domestic", first).alias("domestic"), F.min_by("global", first).alias("global"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.min_by("entry_url", first).alias("entry_url"), F.max_by("exit_url", last).alias("exit_url"), F.sum("page_count").alias("page_count"), *[F.sum(c).alias(c) for c in sums],
    ).drop("no")


def sessionize(log: DataFrame, gap: int = GAP) -> DataFrame:
    """One row per session of a site's visitor; hits are ordered by (timestamp, id).

    Hits are cut by (visitor, day) first and only the parts meet by visitor, so a
    crawler's hits are not one task.
    """
    return merge_parts(session_parts(log, gap), gap)


def session_state(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(*VISITOR).agg(F.max("end_ts").alias("last_ts"))


def extend_sessions(sessions: DataFrame, new: DataFrame, gap: int = GAP) -> DataFrame:
    """Continue each visitor's last session with new hits; hits older than its end are ignored."""
    last = sessions.groupBy(*VISITOR).agg(F.max_by(F.struct(*[c for c in sessions.columns if c not in VISITOR]), "end_ts").alias("s"))
    fresh = new.where(pv()).join(last, VISITOR, "left").where("s is null or timestamp >= s.end_ts")
    first = fresh.groupBy(*VISITOR).agg(F.min("timestamp").alias("t"))
    grown = sessionize(fresh.drop("s"), gap).join(last, VISITOR, "left").join(first, VISITOR)
    joins = F.col("s").isNotNull() & (F.col("start_ts") == F.col("t")) & (F.col("start_ts") - F.col("s.end_ts") <= gap)
    pick = lambda c: F.when(joins, F.col(f"s.{c}")).otherwise(F.col(c)).alias(c)
    grown = grown.select(
        *VISITOR, pick("domestic"), pick("global"), pick("start_ts"), "end_ts", pick("entry_url"), "exit_url",
        (F.col("page_count") + F.when(joins, F.col("s.page_count")).otherwise(0)).alias("page_count"),
    )
    old = sessions.join(grown.select(*VISITOR, "start_ts"), [*VISITOR, "start_ts"], "left_anti")
    return old.select(sessions.columns).unionByName(grown.select(sessions.columns))


def agg_session_daily(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("site_id", F.to_date(F.timestamp_seconds("start_ts")).alias("day")).agg(F.count("*").alias("sessions"))


def agg_entry_daily(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("site_id", F.to_date(F.timestamp_seconds("start_ts")).alias("day"), "entry_url").agg(F.count("*").alias("count"))


def session_metrics_of_rollups(session_daily: DataFrame, entry_daily: DataFrame, d1: str, d2: str, n: int = 10) -> DataFrame:
    """Sessions and top entry pages (entry_url, count) of the days d1 to d2, from roll-ups: one row."""
    days = F.col("day").between(F.lit(d1).cast("date"), F.lit(d2).cast("date"))
    total = session_daily.where(days).agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"))
    return _with_entries(total, entry_daily.where(days).groupBy("entry_url").agg(F.sum("count").alias("count")), n)


def session_metrics_of_sessions(sessions: DataFrame, start: int, end: int, n: int = 10) -> DataFrame:
    """The same from sessions that start in [start, end): one that began earlier counts where it began."""
    s = sessions.where((F.col("start_ts") >= start) & (F.col("start_ts") < end))
    return _with_entries(s.agg(F.count("*").alias("sessions")), s.groupBy("entry_url").agg(F.count("*").alias("count")), n)


def session_metrics_of_hits(log: DataFrame, start: int, end: int, url_like: str | None = None, n: int = 10) -> DataFrame:
    """The same from hits of [start, end), url filter first: a session that crosses the start counts again."""
    return session_metrics_of_sessions(sessionize(log.where(in_range(start, end) & url_filter(url_like))), start, end, n)


def _with_entries(total: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    top = counts.orderBy(F.desc("count"), "entry_url").limit(n)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "entry_url"))).alias("e"))  # n rows
    entries = F.to_json(F.transform("e", lambda x: F.struct(x["entry_url"].alias("entry_url"), (-x["c"]).alias("count"))))
    return total.join(F.broadcast(listed)).select("sessions", entries.alias("entries"))


def entry_pages(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Top entry pages; percent of all entries, rounded."""
    c = sessions.groupBy("entry_url").agg(F.count("*").alias("count"))
    total = sessions.agg(F.count("*").alias("total"))
    top = c.orderBy(F.desc("count"), "entry_url").limit(n)
    return top.join(F.broadcast(total)).select("entry_url", "count", F.round(F.col("count") * 100 / F.col("total")).cast("long").alias("percent"))


def session_list(log: DataFrame, start: int, end: int, gap: int = GAP, **equal: str) -> DataFrame:
    """Sessions of filtered hits (filters come before the cut into sessions), with durations."""
    f = log.where(in_range(start, end))
    for c, v in equal.items():
        f = f.where(F.col(c) == v)
    return sessionize(f, gap).withColumn("duration", F.col("end_ts") - F.col("start_ts"))


def session_page(sessions: DataFrame, page: int, size: int) -> DataFrame:
    order = [F.desc("start_ts"), *VISITOR]
    return sessions.orderBy(*order).offset((page - 1) * size).limit(size)


def session_page_after(sessions: DataFrame, after: dict | None, size: int) -> DataFrame:
    """The page behind a session (its visitor and start_ts), the first one where it is None; every page costs the same."""
    if after is not None:
        same = F.col("start_ts") == after["start_ts"]
        behind = F.struct(*VISITOR) > F.struct(*[F.lit(after[c]).cast("string").alias(c) for c in VISITOR])
        sessions = sessions.where((F.col("start_ts") < after["start_ts"]) | (same & behind))
    return sessions.orderBy(F.desc("start_ts"), *VISITOR).limit(size)


def session_summary(sessions: DataFrame) -> DataFrame:
    s = sessions.agg(F.count("*").alias("sessions"), F.count_if(F.col("page_count") <= 1).alias("bounces"), F.coalesce(F.sum(F.col("end_ts") - F.col("start_ts")), F.lit(0)).alias("d"))
    return s.selectExpr(
        "sessions", "bounces", "case when sessions > 0 then bounces / sessions else 0.0D end as bounce_rate", "case when sessions > 0 then d div sessions else 0 end as mean_duration"
    )
