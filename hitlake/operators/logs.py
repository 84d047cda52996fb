"""Log search, pages, latest hit per visitor, and the display export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basics import MAINLAND, in_range, pv

SORTS = ["timestamp", "ip", "url", "status_code", "bytes_sent", "request_time_ms", "referer", "domestic"]
#: Text patterns of internal addresses in the log filter (not the same set as is_private_ip).
INTERNAL = r"^(10\.|192\.168\.|127\.|172\.(1[6-9]|2[0-9]|3[01])\.|fc|fd|fe80:)|^::1$"


def internal_ip(c: Column) -> Column:
    return c.rlike(INTERNAL)


def search(
    log: DataFrame, *, keyword: str | None = None, start: int | None = None, end: int | None = None, ip: str | None = None,
    location: str | None = None, url: str | None = None, status: int | None = None, status_class: int | None = None,
    no_internal: bool = False, no_bots: bool = False, mainland_only: bool = False, pageviews: bool = False,
    first: DataFrame | None = None, visitors: str = "all", window: tuple[int, int] | None = None,
) -> DataFrame:
    """Filtered hits. Explicit start and end are inclusive. With ``first`` adds is_new for the window."""
    c = F.lit(True)
    if keyword:
        c = c & (F.col("url").contains(keyword) | F.col("ip").contains(keyword) | F.col("referer").contains(keyword) | F.col("domestic").contains(keyword))
    if start is not None:
        c = c & (F.col("timestamp") >= start)
    if end is not None:
        c = c & (F.col("timestamp") <= end)
    if ip:
        c = c & F.col("ip").contains(ip)
    if location:
        c = c & (F.col("domestic").contains(location) | F.col("global").contains(location))
    if url:
        c = c & F.col("url").contains(url)
    if status is not None:
        c = c & (F.col("status_code") == status)
    elif status_class is not None:
        c = c & F.col("status_code").between(status_class * 100, status_class * 100 + 99)
    if no_internal:
        c = c & ~internal_ip(F.col("ip"))
    if no_bots:
        c = c & (F.col("device") != "bot")
    if mainland_only:
        c = c & (F.col("global") == MAINLAND)
    if pageviews:
        c = c & pv()
    out = log.where(c)
    if first is not None:
        lo, hi = window
        out = out.join(first, ["site_id", "ip"], "left").withColumn("is_new", F.coalesce(F.col("first_ts").between(lo, hi - 1), F.lit(False))).drop("first_ts")
        if visitors != "all":
            out = out.where(F.col("is_new") == F.lit(visitors == "new"))
    return out


def page(df: DataFrame, sort: str = "timestamp", descending: bool = True, page: int = 1, size: int = 50) -> DataFrame:
    """A page in sort order, ties by id in the same direction."""
    if sort not in SORTS or size > 1000:
        raise ValueError("unknown sort column or page size over 1000")
    order = [F.desc(sort), F.desc("id")] if descending else [F.asc(sort), F.asc("id")]
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, after: tuple | None, sort: str = "timestamp", descending: bool = True, size: int = 50) -> DataFrame:
    """The page behind a row, by its (sort value, id); the first page where ``after`` is None.

    Only rows behind it are looked at and ``size`` of them kept in each task, so page 10,000
    costs what page 1 costs; with ``page`` the rows before it would all be sorted first.
    Nulls come last in descending order, first in ascending, as in ``page``.
    """
    if sort not in SORTS or size > 1000:
        raise ValueError("unknown sort column or page size over 1000")
    order = [F.desc(sort), F.desc("id")] if descending else [F.asc(sort), F.asc("id")]
    if after is not None:
        value, row = after
        c, behind = F.col(sort), F.col("id") < row if descending else F.col("id") > row
        if value is None:
            beyond = (c.isNull() & behind) if descending else (c.isNull() & behind) | c.isNotNull()
        else:
            beyond = ((c < value) | c.isNull() if descending else c > value) | ((c == value) & behind)
        df = df.where(beyond)
    return df.orderBy(*order).limit(size)


def search_facts(
    fact: DataFrame, dims: dict[str, DataFrame], *, keyword: str | None = None, ip: str | None = None, location: str | None = None, url: str | None = None, **more
) -> DataFrame:
    """Stored facts that a search finds, not yet decoded: texts are looked for in the dimensions, and facts meet only the ids found.

    ``more`` are filters of ``search`` on columns that facts have (times, status, page views).
    No text is read from, or joined to, a fact that the search leaves out.
    """
    wanted = {"ip": ip and F.col("ip").contains(ip), "url": url and F.col("url").contains(url)}
    wanted["location"] = location and (F.col("domestic").contains(location) | F.col("global").contains(location))
    out = search(fact, **more)
    for name, c in wanted.items():
        if c is not None:
            out = out.join(dims[name].where(c).select(f"{name}_id"), f"{name}_id", "left_semi")
    if keyword:
        found = F.lit(False)
        for name, column in (("url", "url"), ("ip", "ip"), ("referer", "referer"), ("location", "domestic")):
            ids = dims[name].where(F.col(column).contains(keyword)).select(f"{name}_id", F.lit(True).alias(f"__{name}"))
            out, found = out.join(ids, f"{name}_id", "left"), found | F.col(f"__{name}").isNotNull()
        out = out.where(found).drop("__url", "__ip", "__referer", "__location")
    return out.select(fact.columns)


def page_with_more(df: DataFrame, sort: str = "timestamp", descending: bool = True, page_no: int = 1, size: int = 50) -> DataFrame:
    """A page with has_more, found by one row more than it shows instead of a count of all."""
    if sort not in SORTS or size > 1000:
        raise ValueError("unknown sort column or page size over 1000")
    order = [F.desc(sort), F.desc("id")] if descending else [F.asc(sort), F.asc("id")]
    rows = df.orderBy(*order).offset((page_no - 1) * size).limit(size + 1)
    n = rows.withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # size + 1 rows
    return n.withColumn("has_more", F.count("*").over(Window.partitionBy()) > size).where(F.col("__n") <= size).drop("__n")


def count_pages(df: DataFrame, size: int = 50) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_distinct("ip").alias("ips")).withColumn("pages", F.expr(f"(total + {size - 1}) div {size}"))


def latest_per_ip(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("ip").orderBy(F.desc("timestamp"), F.desc("id"))
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def page_of_fact(fact: DataFrame, dims: dict[str, DataFrame], size: int = 50) -> DataFrame:
    """Late lookup: sort and limit the fact first, join the dimensions to one page of rows."""
    out = F.broadcast(fact.orderBy(F.desc("timestamp"), F.desc("id")).limit(size))  # at most ``size`` rows
    for k, d in dims.items():
        out = d.join(out, f"{k}_id").drop(f"{k}_id")
        out = F.broadcast(out)
    return out


#: Columns of the export in order, with their headings in the source's other language (fixed values).
HEADINGS = {
    "time": "时间", "ip": "IP", "location": "位置", "request": "请求", "status": "状态码", "bytes": "流量(字节)", "traffic": "流量(可读)", "request_length": "请求大小",
    "duration": "请求耗时", "upstream_duration": "上游耗时", "host": "Host", "request_id": "请求ID", "upstream_addr": "上游地址", "referer": "来源", "browser": "浏览器",
    "os": "系统", "device": "设备", "pageview": "PV",
}


def traffic(c: Column) -> Column:
    """Bytes with two digits and a unit; halves go to the even digit."""
    text = lambda power, unit: F.concat(F.format_string("%.2f", F.bround(c / 1024.0**power, 2)), F.lit(f" {unit}"))
    out = text(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(c < 1024 ** (power + 1), text(power, unit)).otherwise(out)
    return out


def display(df: DataFrame, lang: str = "en") -> DataFrame:
    """Rows as the export shows them: 18 columns after id."""
    dash = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    ms = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" ms"))).otherwise("-")
    place = F.coalesce(F.nullif(F.trim("domestic"), F.lit("")), F.nullif(F.trim("global"), F.lit("")), F.lit("-"))
    yes, no = ("Yes", "No") if lang == "en" else ("是", "否")
    cols = {
        "time": F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss"), "ip": F.col("ip"), "location": place, "request": dash(F.concat_ws(" ", "method", "url")),
        "status": F.col("status_code").cast("string"), "bytes": F.col("bytes_sent"), "traffic": traffic(F.col("bytes_sent")), "request_length": F.col("request_length"),
        "duration": ms("request_time_ms"), "upstream_duration": ms("upstream_response_time_ms"), "pageview": F.when(pv(), yes).otherwise(no),
    }
    return df.select("id", *[cols.get(k, dash(F.col(k))).alias(k if lang == "en" else HEADINGS[k]) for k in HEADINGS])


def export(df: DataFrame, path: str, fmt: str = "csv", lang: str = "en") -> None:
    """Write every row of a query: one distributed job, no paging."""
    w = display(df, lang).drop("id").write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)
