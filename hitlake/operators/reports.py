"""Rankings, totals, series, realtime, developer day, comparisons.

A report counts the hits it is given: ask for one site by filtering on site_id first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basics import MAINLAND, SEARCH_ENGINES, SLOW_MS, day, hour, in_range, pv, share, spine, status_counts, url_filter, uv
from .sessions import VISITOR, entry_pages, merge_parts, session_parts, sessionize


def is_search(c: Column) -> Column:
    return F.lower(c).rlike("|".join(x.replace(".", "\\.") for x in SEARCH_ENGINES))


def is_direct(c: Column) -> Column:
    return c.isin("-", "")


def referer_label(c: Column, domains: list[str]) -> Column:
    """direct, internal (a url of one of the domains itself, not of a host below it) or the referer."""
    own = F.lit(False)
    for d in domains:
        own = own | c.rlike(rf"(?s)^http.*://{re.escape(d)}(?:[/:].*)?$")
    return F.when(is_direct(c), "direct").when(own, "internal").otherwise(c)


def source_kind(c: Column) -> Column:
    return F.when(is_direct(c), "direct").when(is_search(c), "search").otherwise("external")


def key_column(kind: str, domains: list[str] = ()) -> tuple[Column, Column]:
    """(group key, extra condition) of a ranking."""
    mainland = F.col("global") == MAINLAND
    return {
        "referer": (referer_label(F.col("referer"), list(domains)), F.lit(True)),
        "province": (F.substring_index("domestic", "·", 1), mainland),
        "city": (F.regexp_replace("domestic", "^[^·]*·", ""), mainland),
        "country": (F.col("global"), F.lit(True)),
    }.get(kind, (F.col(kind), F.lit(True)))


def ranking(log: DataFrame, kind: str, start: int, end: int, n: int = 10, url_like: str | None = None, domains: list[str] = (), source: str = "all") -> DataFrame:
    """Top n keys by UV then PV (url: PV then UV), ties by key; shares of the returned rows."""
    key, more = key_column(kind, domains)
    base = log.where(pv() & in_range(start, end) & more & url_filter(url_like))
    if source != "all":
        base = base.where(source_kind(F.col("referer")) == source)
    g = base.groupBy(key.alias("key")).agg(F.count("*").alias("pv"), uv().alias("uv"))
    order = [F.desc("pv"), F.desc("uv")] if kind == "url" else [F.desc("uv"), F.desc("pv")]
    return g.orderBy(*order, "key").limit(n).select("key", "pv", "uv", share("pv", 6).alias("pv_share"), share("uv", 6).alias("uv_share"))


def referer_ips(log: DataFrame, start: int, end: int, n: int = 10) -> DataFrame:
    """Four groups (all, search, direct, external): top ips by hits, share, most frequent location.

    One pass: hits are counted by kind, ip and location; a count goes to 'all' and to its
    own group, and ips are limited before their locations are compared.
    """
    k = log.where(pv() & in_range(start, end)).groupBy(source_kind(F.col("referer")).alias("kind"), "ip", "domestic", "global").agg(F.count("*").alias("n"))
    b = k.select("ip", "domestic", "global", "n", F.explode(F.array(F.lit("all"), "kind")).alias("group"))
    c = b.groupBy("group", "ip").agg(F.sum("n").alias("hits"))
    total = c.groupBy("group").agg(F.sum("hits").alias("total"))
    w = Window.partitionBy("group").orderBy(F.desc("hits"), "ip")
    top = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    loc = b.join(top.select("group", "ip"), ["group", "ip"], "left_semi").groupBy("group", "ip", "domestic", "global").agg(F.sum("n").alias("c"))
    w = Window.partitionBy("group", "ip").orderBy(F.desc("c"), "global", "domestic")
    loc = loc.withColumn("r", F.row_number().over(w)).where("r = 1").select("group", "ip", "domestic", "global")
    return top.join(total, "group").join(loc, ["group", "ip"], "left").select(
        "group", "ip", "rank", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("share"), "domestic", "global"
    )


def totals_filtered(log: DataFrame, start: int, end: int, url_like: str | None = None) -> DataFrame:
    return log.where(pv() & in_range(start, end) & url_filter(url_like)).agg(
        F.count("*").alias("pv"), uv().alias("uv"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("traffic")
    )


def status_hits(log: DataFrame, start: int, end: int) -> DataFrame:
    return log.where(in_range(start, end)).agg(*status_counts())


def active_visitors(log: DataFrame, now: int, minutes: int = 15) -> DataFrame:
    """Visitors of the last minutes, a hit at ``now`` not among them."""
    return log.where(pv() & in_range(now - minutes * 60, now)).agg(uv().alias("active"))


def new_returning(log: DataFrame, first: DataFrame, start: int, end: int) -> DataFrame:
    act = log.where(pv() & in_range(start, end)).select("site_id", "ip").distinct().join(first, ["site_id", "ip"], "left")
    new = F.col("first_ts").between(start, end - 1)
    return act.agg(F.count_if(new).alias("new"), F.count_if(~F.coalesce(new, F.lit(False))).alias("returning"))


_COUNTS = ("traffic", "s2xx", "s3xx", "s4xx", "s5xx", "other")
_SUMS = ("pv", *_COUNTS, "sessions", "bounces", "seconds")
SNAPSHOT = ("pv", "uv", "sessions")


def range_stats(log: DataFrame, ranges: dict[str, tuple[int, int]], first: DataFrame | None = None, entries: int = 0) -> DataFrame:
    """A row for each named range [start, end) that has hits, from one pass over the hits.

    A hit is tagged with the ranges it lies in and repeated only for those; sessions are
    cut by (tag, visitor), so a range's sessions are those of its hits alone, and counts, status
    classes, sessions and visitors are then summed up by address and by range. Columns: tag,
    pv, uv, traffic, status classes, sessions, bounces, seconds (of all sessions),
    new and returning (with ``first``: site_id, ip, first_ts), and entries, the first
    ``entries`` entry pages by count as an array of (count, url).
    """
    tags = F.array_compact(F.array(*[F.when(in_range(a, b), F.lit(k)) for k, (a, b) in ranges.items()]))
    inside = F.lit(False)
    for a, b in ranges.values():
        inside = inside | in_range(a, b)
    viewed = F.coalesce(pv(), F.lit(False))
    s = F.col("status_code")
    kinds = {f"s{k}xx": s.between(k * 100, k * 100 + 99) for k in (2, 3, 4, 5)} | {"other": (s < 200) | (s >= 600)}
    h = log.where(inside).select(
        *VISITOR, "timestamp", "id", "url", "domestic", "global", viewed.alias("viewed"), F.when(viewed, F.col("bytes_sent")).otherwise(0).alias("traffic"),
        *[F.coalesce(c.cast("long"), F.lit(0)).alias(k) for k, c in kinds.items()], F.explode(tags).alias("tag"),
    )
    keys = ["tag", "viewed", *VISITOR]
    one = merge_parts(session_parts(h, keys=keys, sums=_COUNTS), keys=keys, sums=_COUNTS)
    of_views = lambda c: F.when(F.col("viewed"), c).otherwise(0).cast("long")
    own = {"pv": of_views(F.col("page_count")), **{c: F.col(c) for c in _COUNTS}, "sessions": of_views(F.lit(1)), "bounces": of_views((F.col("page_count") <= 1).cast("int")),
           "seconds": of_views(F.col("end_ts") - F.col("start_ts"))}
    row = lambda kind, site, key, cols: F.struct(F.lit(kind).alias("kind"), site.alias("site_id"), F.col(key).alias("key"), *[v.cast("long").alias(k) for k, v in cols.items()])
    rows = [row("ip", F.col("site_id"), "ip", own)]
    if entries:
        rows.append(F.when(F.col("viewed"), row("entry", F.lit(None).cast("string"), "entry_url", {k: F.lit(int(k == "sessions")) for k in own})))
    by = one.select("tag", F.inline(F.array_compact(F.array(*rows)))).groupBy("tag", "kind", "site_id", "key").agg(*[F.sum(c).alias(c) for c in _SUMS])
    fresh = F.lit(False)
    if first is not None:
        by = by.join(first.select("site_id", F.col("ip").alias("key"), "first_ts"), ["site_id", "key"], "left")
        for k, (a, b) in ranges.items():
            fresh = fresh | ((F.col("tag") == k) & F.col("first_ts").between(a, b - 1))
    seen = (F.col("kind") == "ip") & (F.col("pv") > 0)
    new = F.coalesce(fresh, F.lit(False))
    by = by.groupBy("tag", "kind", "key").agg(*[F.sum(c).alias(c) for c in _SUMS], F.count_if(seen & new).alias("new"), F.count_if(seen & ~new).alias("returning"))
    if entries:  # addresses each are a group of one, entry pages one group of which the first stay
        w = Window.partitionBy("tag", "kind", F.when(F.col("kind") == "ip", F.col("key"))).orderBy(F.desc("sessions"), "key")
        by = by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= entries)
    mine = F.col("kind") == "ip"
    listed = F.array_sort(F.collect_list(F.when(~mine, F.struct((-F.col("sessions")).alias("c"), F.col("key").alias("entry_url")))))
    return by.groupBy("tag").agg(
        F.count_if(seen & F.col("key").isNotNull()).alias("uv"), *[F.sum(F.when(mine, F.col(c))).alias(c) for c in (*_SUMS, "new", "returning")],
        F.transform(listed, lambda x: F.struct((-x["c"]).alias("count"), x["entry_url"].alias("entry_url"))).alias("entries"),
    )


def _at(tag: str, c: str) -> Column:
    """What ``range_stats`` has for a tag, 0 where it has none: an aggregate over its rows."""
    return F.coalesce(F.max(F.when(F.col("tag") == tag, F.col(c))), F.lit(0))


def _flat(stats: DataFrame, columns: dict[str, tuple[str, str]], *more: Column) -> DataFrame:
    """One row: each column the value at (tag, name)."""
    return stats.agg(*[_at(tag, c).alias(name) for name, (tag, c) in columns.items()], *more)


def snapshot(log: DataFrame, start: int, end: int) -> DataFrame:
    """(pv, uv, sessions) of a range, one row."""
    return _flat(range_stats(log, {"it": (start, end)}), {c: ("it", c) for c in SNAPSHOT})


def _compared(start: int, end: int, previous: int, now: int) -> dict[str, tuple[int, int]]:
    length, elapsed = end - start, min(max(now - start, 0), end - start)
    return {"current": (start, end), "previous": (previous, previous + length), "same_time": (previous, previous + elapsed)}


def compare(log: DataFrame, start: int, end: int, previous: int, now: int) -> DataFrame:
    """Range, previous range and previous range up to the same elapsed time, one row."""
    ranges = _compared(start, end, previous, now)
    return _flat(range_stats(log, ranges), {f"{k}_{c}": (k, c) for k in ranges for c in SNAPSHOT})


def forecast(log: DataFrame, start: int, end: int, now: int) -> DataFrame:
    """What the whole range will come to, from what is there at ``now``: pv, uv and sessions, one row."""
    cols = {c: ("done", c) for c in SNAPSHOT} | {f"r_{c}": ("recent", c) for c in SNAPSHOT}
    return _flat(range_stats(log, _recent(start, end, now)), cols).select(*forecast_columns(start, end, now))


def _recent(start: int, end: int, now: int) -> dict[str, tuple[int, int]]:
    """The part of the range that is over, and its last two hours at most."""
    now = min(max(now, start), end)
    return {"done": (start, now), "recent": (max(now - 7200, start), now)}


def forecast_columns(start: int, end: int, now: int, done: str = "", recent: str = "r_") -> list[Column]:
    """Forecasts over the columns of a snapshot up to ``now`` and of one of the last two hours before it.

    By progress: the counts scaled by the share of time gone. By rate: that, and the last hours'
    rate over the time left. Both are rounded and blended, the rate with 0.7 up to a day, 0.5
    up to a week, 0.3 beyond. With less than half an hour, no time left or nothing in the last
    hours it is the first alone.
    """
    now = min(max(now, start), end)
    elapsed, left, length = now - start, end - now, end - start
    window = min(7200, elapsed)
    weight = 0.7 if length <= 86400 else 0.5 if length <= 7 * 86400 else 0.3
    idle = F.lit(True)
    for c in SNAPSHOT:
        idle = idle & (F.col(recent + c) == 0)

    def one(c: str) -> Column:
        scaled = F.round(F.col(done + c) * (length / elapsed)) if 0 < elapsed < length else F.col(done + c).cast("double")
        if window < 1800 or left <= 0:
            return scaled.cast("long").alias(f"forecast_{c}")
        rated = F.round(scaled + F.col(recent + c) / window * left)
        return F.when(idle, scaled).otherwise(F.round(rated * weight + scaled * (1 - weight))).cast("long").alias(f"forecast_{c}")

    return [one(c) for c in SNAPSHOT]


def timeseries(log: DataFrame, start: int, end: int, grain: str = "hourly", url_like: str | None = None) -> DataFrame:
    """PV, UV and PV - UV per bucket, zero-filled."""
    step = 3600 if grain == "hourly" else 86400
    bucket = hour() if grain == "hourly" else F.unix_timestamp(F.date_trunc("day", F.timestamp_seconds("timestamp")))
    g = log.where(pv() & in_range(start, end) & url_filter(url_like)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("pv"), uv().alias("uv"))
    s = spine(log.sparkSession, start, end, step).join(g, "bucket", "left").na.fill(0, ["pv", "uv"])
    return s.withColumn("pv_minus_uv", F.col("pv") - F.col("uv"))


def minute_series(log: DataFrame, now: int, minutes: int = 30) -> DataFrame:
    """UV of each minute from the one in which the window begins, ``minutes`` of them, zero-filled; hits of the window count."""
    first = (now - minutes * 60) // 60 * 60
    g = log.where(pv() & in_range(now - minutes * 60, now)).groupBy((F.expr("timestamp div 60") * 60).alias("bucket")).agg(uv().alias("uv"))
    return spine(log.sparkSession, first, first + minutes * 60, 60).join(g, "bucket", "left").na.fill(0, ["uv"])


def device_breakdown(log: DataFrame, now: int, minutes: int = 30) -> DataFrame:
    """UV per device, summed by category on purpose (a visitor with two devices counts twice): four rows, pc, mobile, apple and other."""
    g = log.where(pv() & in_range(now - minutes * 60, now)).groupBy("device").agg(uv().alias("uv"))
    cat = F.when(F.col("device") == "desktop", "pc").when(F.col("device").isin("mobile", "tablet"), "mobile").when(F.col("device") == "apple", "apple").otherwise("other")
    sums = g.groupBy(cat.alias("category")).agg(F.sum("uv").alias("uv"))
    rows = log.sparkSession.createDataFrame([(x,) for x in ("pc", "mobile", "apple", "other")], "category string").join(F.broadcast(sums), "category", "left")  # four rows
    return rows.na.fill(0, ["uv"]).withColumn("share", share("uv", 6))


def realtime_top(log: DataFrame, kind: str, now: int, minutes: int = 30, n: int = 10, domains: list[str] = ()) -> DataFrame:
    """Top keys of the window: by PV for url, by UV otherwise; blank keys are 'unknown'."""
    key, _ = key_column(kind, domains)
    value = F.count("*") if kind == "url" else uv()
    g = log.where(pv() & in_range(now - minutes * 60, now)).groupBy(F.when(F.trim(key) == "", "unknown").otherwise(key).alias("key")).agg(value.alias("value"))
    return g.orderBy(F.desc("value"), "key").limit(n).withColumn("share", share("value", 6))


def realtime_entries(log: DataFrame, now: int, minutes: int = 30, n: int = 10) -> DataFrame:
    return entry_pages(sessionize(log.where(in_range(now - minutes * 60, now))), n)


def _day_metrics() -> list[Column]:
    s, t, u, b = (F.col(c) for c in ("status_code", "request_time_ms", "upstream_response_time_ms", "request_length"))
    mean = lambda c: F.round(F.avg(F.when(c > 0, c)), 4)
    return [
        F.count("*").alias("requests"), F.count_if(s.between(400, 499)).alias("s4xx"), F.count_if(s.between(500, 599)).alias("s5xx"),
        F.count_if(t >= SLOW_MS).alias("slow"), F.count_if(t > 0).alias("timed"), F.count_if(u > 0).alias("upstream_timed"),
        F.count_if(b > 0).alias("sized"), mean(t).alias("avg_ms"), mean(u).alias("avg_upstream_ms"), mean(b).alias("avg_length"),
    ]


def day_snapshot(log: DataFrame, start: int) -> DataFrame:
    return log.where(in_range(start, start + 86400)).agg(*_day_metrics())


#: Metrics of the developer report, and those that are shares of the day's requests.
METRICS = ["requests", "avg_length", "s5xx", "s4xx", "avg_ms", "avg_upstream_ms", "slow", "slow_rate"]
SHARED = ["s5xx", "s4xx", "slow"]


def compare_days(current: DataFrame, previous: DataFrame) -> DataFrame:
    """A row for each metric of two ``day_snapshot`` rows: value, previous, delta, rate and shares.

    rate is null when previous is 0 and the value is not, 0 when both are; a share is null
    without requests.
    """

    def tall(df: DataFrame, value: str, share_name: str) -> DataFrame:
        r = df.withColumn("slow_rate", F.when(F.col("requests") > 0, F.col("slow") / F.col("requests")).otherwise(0.0))
        own = [F.struct(
            F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(value),
            (F.when(F.col("requests") > 0, F.round(F.col(m) / F.col("requests"), 6)) if m in SHARED else F.lit(None).cast("double")).alias(share_name),
        ) for m in METRICS]
        return r.select(F.inline(F.array(*own)))

    j = tall(current, "value", "share").join(F.broadcast(tall(previous, "previous", "previous_share")), "metric")  # a row per metric
    rate = F.when(F.col("previous") != 0, F.round((F.col("value") - F.col("previous")) / F.col("previous"), 6)).when(F.col("value") == 0, 0.0)
    return j.select(
        "metric", F.round("value", 6).alias("value"), F.round("previous", 6).alias("previous"), F.round(F.col("value") - F.col("previous"), 6).alias("delta"), rate.alias("rate"), "share", "previous_share"
    )


def metric_compare(log: DataFrame, start: int, previous: int | None = None) -> DataFrame:
    """``compare_days`` of the day that starts at ``start`` and another, the day before by default."""
    return compare_days(day_snapshot(log, start), day_snapshot(log, start - 86400 if previous is None else previous))


def developer_report(log: DataFrame, start: int, previous: int | None = None) -> DataFrame:
    """The whole developer report: (part, place, name, metric, value, previous, delta, rate).

    summary: a row per metric; trend: a row per day and series of the last seven days;
    issue: three rows for each problem url, in order of rank.
    """
    none = F.lit(None).cast("double")
    order = F.element_at(F.create_map(*[x for i, m in enumerate(METRICS) for x in (F.lit(m), F.lit(i + 1))]), F.col("metric"))
    summary = metric_compare(log, start, previous).select(F.lit("summary").alias("part"), order.alias("place"), F.lit("").alias("name"), "metric", "value", "previous", "delta", "rate")
    series = [F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value")) for m in ("s4xx", "s5xx", "avg_ms", "avg_upstream_ms", "slow_rate")]
    place = F.datediff("day", F.to_date(F.timestamp_seconds(F.lit(start - 6 * 86400)))) + 1
    trend = week_trend(log, start).select(F.lit("trend").alias("part"), place.alias("place"), F.date_format("day", "yyyy-MM-dd").alias("name"), F.inline(F.array(*series)))
    trend = trend.select("part", "place", "name", "metric", "value", none.alias("previous"), none.alias("delta"), none.alias("rate"))
    rows = [F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value"), (F.col(d).cast("double") if d else none).alias("delta"))
            for m, d in (("s5xx", "s5xx_delta"), ("slow", None), ("mean_ms", "mean_delta"))]
    issue = problem_urls(log, start, previous=previous).select(F.lit("issue").alias("part"), F.col("rank").alias("place"), F.col("url").alias("name"), F.inline(F.array(*rows)))
    issue = issue.select("part", "place", "name", "metric", "value", none.alias("previous"), "delta", none.alias("rate"))
    return summary.unionByName(trend).unionByName(issue)


def week_trend(log: DataFrame, start: int) -> DataFrame:
    """Seven days up to the day that starts at ``start``: one grouped pass and a spine."""
    first = start - 6 * 86400
    g = log.where(in_range(first, start + 86400)).groupBy(day().alias("day")).agg(*_day_metrics())
    days = spine(log.sparkSession, first, start + 86400, 86400).select(F.to_date(F.timestamp_seconds("bucket")).alias("day"))
    t = days.join(g, "day", "left").na.fill(0, ["requests", "s4xx", "s5xx", "slow", "timed", "upstream_timed", "sized"])
    return t.withColumn("slow_rate", F.when(F.col("requests") > 0, F.round(F.col("slow") / F.col("requests"), 6)).otherwise(0.0))


def problem_urls(log: DataFrame, start: int, n: int = 8, previous: int | None = None) -> DataFrame:
    """Urls with 5xx, slow hits or a high mean, in order of rank, against the day before or another (one join)."""
    previous = start - 86400 if previous is None else previous
    t = F.col("request_time_ms")
    agg = [F.count("*").alias("requests"), F.count_if(F.col("status_code").between(500, 599)).alias("s5xx"), F.count_if(t >= SLOW_MS).alias("slow"), F.avg(F.when(t > 0, t)).alias("mean")]
    g = log.where(in_range(start, start + 86400)).groupBy("url").agg(*agg).where("s5xx > 0 or slow > 0 or mean >= 500")
    order = [F.desc("s5xx"), F.desc("slow"), F.desc(F.coalesce("mean", F.lit(0.0))), F.desc("requests"), F.asc("url")]
    top = g.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows
    prev = log.where(in_range(previous, previous + 86400)).groupBy("url").agg(*agg).select("url", F.col("s5xx").alias("p5xx"), F.col("mean").alias("pmean"))
    j = top.join(prev, "url", "left")
    return j.select(
        "rank", "url", "requests", "s5xx", "slow", F.round("mean", 4).alias("mean_ms"), (F.col("s5xx") - F.coalesce("p5xx", F.lit(0))).alias("s5xx_delta"),
        F.round(F.coalesce("mean", F.lit(0.0)) - F.coalesce("pmean", F.lit(0.0))).cast("long").alias("mean_delta"),
    )


def health_digest(log: DataFrame, start: int, previous: int | None = None) -> DataFrame:
    """stable / watch / critical from two days: 5xx, latency, upstream time, and the top problem url.

    Each term that is there adds one point, two where it is grave: 5xx share of 3 % or ten
    more than before, 200 ms slower, upstream 150 ms slower, a problem url with 5xx.
    """
    m = metric_compare(log, start, previous)
    pick = lambda name, c: F.max(F.when(F.col("metric") == name, F.col(c)))
    one = m.agg(
        F.coalesce(pick("s5xx", "share"), F.lit(0.0)).alias("share_5xx"), pick("s5xx", "value").alias("n5"), pick("s5xx", "delta").alias("d5"), pick("avg_ms", "value").alias("ms"),
        pick("avg_ms", "delta").alias("latency_delta"), pick("avg_upstream_ms", "value").alias("up"), pick("avg_upstream_ms", "delta").alias("upstream_delta"),
    )
    top = problem_urls(log, start, 1, previous).agg(F.max("url").alias("top_url"), F.max("s5xx").alias("top_5xx"))
    c = F.col
    grave = lambda there, bad: F.when(~there, 0).when(bad, 2).otherwise(1)
    terms = [
        grave((c("n5") > 0) | (c("d5") > 0), (c("share_5xx") >= 0.03) | (c("d5") >= 10)), grave((c("ms") > 0) & (c("latency_delta") > 0), c("latency_delta") >= 200),
        grave((c("up") > 0) & (c("upstream_delta") > 0), c("upstream_delta") >= 150), grave(c("top_url").isNotNull(), F.coalesce(c("top_5xx") > 0, F.lit(False))),
    ]
    j = one.join(F.broadcast(top)).withColumn("score", terms[0] + terms[1] + terms[2] + terms[3])  # one row each
    level = F.when(c("score") == 0, "stable").when(c("score") >= 4, "critical").otherwise("watch")
    return j.select("share_5xx", "latency_delta", "upstream_delta", "top_url", "score", level.alias("level"))


def overall(log: DataFrame, first: DataFrame, start: int, end: int, previous: tuple[int, int], now: int, url_like: str | None = None, n: int = 10) -> DataFrame:
    """The landing report as one row: totals, sessions with entry pages, active, new and returning visitors,
    status classes, the previous range's, and the comparison snapshots with the forecast.

    Everything is counted in [start, end) of hits that the url filter leaves; ``first`` is ``first_seen``.
    """
    ranges = _compared(start, end, previous[0], now) | {"before": previous, "active": (now - 900, now)} | _recent(start, end, now)
    plain, split, status = ("pv", "uv", "traffic", "sessions"), ("new", "returning"), ("s2xx", "s3xx", "s4xx", "s5xx", "other")
    cols = {c: ("current", c) for c in (*plain, *split, *status)} | {"active": ("active", "uv")} | {f"previous_{c}": ("before", c) for c in (*split, *status)}
    cols |= {f"{k}_{c}": (k, c) for k in ("previous", "same_time", "done", "recent") for c in SNAPSHOT}
    top = F.max(F.when(F.col("tag") == "current", F.transform("entries", lambda x: F.struct(x["entry_url"].alias("entry_url"), x["count"].alias("count")))))
    one = _flat(range_stats(log.where(url_filter(url_like)), ranges, first, n), cols, F.to_json(F.coalesce(top, F.array())).alias("entries"))
    return one.select("*", *forecast_columns(start, end, now, "done_", "recent_")).drop(*[f"{k}_{c}" for k in ("done", "recent") for c in SNAPSHOT])


def _rate(value: Column, previous: Column) -> Column:
    return F.when(previous != 0, F.round((value - previous) / previous, 6))


def kpi_cards(log: DataFrame, start: int, end: int, previous: tuple[int, int]) -> DataFrame:
    """A row for each figure of the dashboard: value, previous, delta, rate (null when previous is 0)."""

    stats = range_stats(log, {"value": (start, end), "previous": previous})

    def cards(tag: str) -> dict[str, Column]:
        x = {c: _at(tag, c) for c in ("pv", "uv", "sessions", "bounces", "seconds")}
        some = lambda by, v: F.when(by > 0, v).otherwise(0.0)
        return {"pv": x["pv"], "uv": x["uv"], "sessions": x["sessions"], "bounce_rate": some(x["sessions"], x["bounces"] / x["sessions"]),
                "duration": some(x["sessions"], F.floor(x["seconds"] / x["sessions"])), "pv_per_visitor": some(x["uv"], x["pv"] / x["uv"])}

    now, before = cards("value"), cards("previous")
    rows = [F.struct(F.lit(k).alias("card"), F.round(now[k].cast("double"), 6).alias("value"), F.round(before[k].cast("double"), 6).alias("previous")) for k in now]
    j = stats.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return j.withColumn("delta", F.round(F.col("value") - F.col("previous"), 6)).withColumn("rate", _rate(F.col("value"), F.col("previous")))


def visitor_shares(log: DataFrame, first: DataFrame, start: int, end: int, previous: tuple[int, int]) -> DataFrame:
    """New and returning visitors with their share, and how they changed."""
    now, before = new_returning(log, first, start, end), new_returning(log, first, *previous).select(F.col("new").alias("p_new"), F.col("returning").alias("p_returning"))
    j = now.join(F.broadcast(before))  # one row each
    total = F.col("new") + F.col("returning")
    rows = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("count"), F.when(total > 0, F.round(F.col(k) / total, 6)).otherwise(0.0).alias("share"), F.col(f"p_{k}").alias("previous")) for k in ("new", "returning")]
    return j.select(F.inline(F.array(*rows))).withColumn("rate", _rate(F.col("count"), F.col("previous")))


def device_totals(log: DataFrame, start: int, end: int) -> DataFrame:
    """UV by category (desktop, mobile, apple, other), and of iOS and Android systems; shares of the categories' total.

    UV is counted by device and by system and then summed, as the dashboard does.
    """
    f = log.where(pv() & in_range(start, end))
    label = F.lower(F.col("device"))
    cat = F.when(label.rlike("mac|iphone|ipad|apple"), "apple").when(label.rlike("desktop|pc|windows"), "desktop").when(label.rlike("mobile|phone|tablet|android"), "mobile").otherwise("other")
    d = f.groupBy("device").agg(uv().alias("uv")).groupBy(cat.alias("name")).agg(F.sum("uv").alias("uv")).withColumn("share", share("uv", 6))
    system = F.when(F.lower("os").rlike("ios|iphone|ipad"), "os:ios").when(F.lower("os").contains("android"), "os:android")
    o = f.groupBy("os").agg(uv().alias("uv")).select(system.alias("name"), "uv").where("name is not null").groupBy("name").agg(F.sum("uv").alias("uv"))
    return d.unionByName(o.withColumn("share", F.lit(None).cast("double")))


def period_over_period(current: DataFrame, previous: DataFrame, value: str = "pv") -> DataFrame:
    """Ranking rows with the previous value by key (0 if absent), delta and rate (null when previous is 0)."""
    p = previous.select("key", F.col(value).alias("previous"))
    j = current.select("key", F.col(value).alias("value")).join(p, "key", "left").na.fill(0, ["previous"])
    return j.withColumn("delta", F.col("value") - F.col("previous")).withColumn(
        "rate", F.when(F.col("previous") != 0, F.round((F.col("value") - F.col("previous")) / F.col("previous"), 6))
    )


def rising_falling(pop: DataFrame) -> DataFrame:
    r = pop.where("rate is not null")
    return r.agg(F.max(F.struct("rate", "key"))["key"].alias("rising"), F.min(F.struct("rate", "key"))["key"].alias("falling"))


def peak_hours(series: DataFrame) -> DataFrame:
    """Bucket with the most and the least page views; the first wins ties."""
    return series.agg(
        F.max_by("bucket", F.struct("pv", -F.col("bucket"))).alias("peak"), F.min_by("bucket", F.struct("pv", "bucket")).alias("trough")
    )


def referer_groups(log: DataFrame, start: int, end: int) -> DataFrame:
    g = log.where(pv() & in_range(start, end)).groupBy(source_kind(F.col("referer")).alias("kind"))
    return g.agg(uv().alias("uv"), F.count("*").alias("pv"))


def map_rows(log: DataFrame, start: int, end: int, names: DataFrame, n: int = 10) -> DataFrame:
    """Country ranking with unified names; pending and unknown dropped, a flag says whether any was pending."""
    g = log.where(pv() & in_range(start, end)).groupBy(F.col("global").alias("raw")).agg(uv().alias("uv"))
    flag = g.agg(F.coalesce(F.max((F.col("raw") == "pending").cast("int")), F.lit(0)).alias("any_pending"))
    j = g.where(~F.col("raw").isin("pending", "unknown", "overseas")).join(names, "raw", "left").groupBy(F.coalesce("name", "raw").alias("name")).agg(F.sum("uv").alias("uv"))
    return j.orderBy(F.desc("uv"), "name").limit(n).join(F.broadcast(flag))
