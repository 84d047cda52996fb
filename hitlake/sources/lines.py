"""Log lines: readers, twelve line formats, and the parse job from lines to hits.

A format is a pattern whose groups bear the names of columns. The job matches a line
once: the groups are written side by side with a separator, split into an array, and
every column is an expression over that array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.operators.basics import bind

NGINX_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
#: Between the fields of a matched line; a line that holds it itself has it as a space.
SEP = "\u0001"
#: Field names of a format that fill a column, the first that a format has (fixed values).
ALIASES_OF = {
    "ip": ["ip", "remote_addr", "real_client_ip", "client_ip", "http_x_forwarded_for"],
    "time": ["time", "time_local", "time_iso8601"],
    "method": ["method", "request_method"],
    "url": ["url", "request_uri", "uri", "path"],
    "query": ["query", "args", "query_string", "cs_uri_query"],
    "status": ["status"],
    "bytes": ["bytes", "body_bytes_sent", "bytes_sent"],
    "referer": ["referer", "http_referer"],
    "ua": ["ua", "user_agent", "http_user_agent"],
    "request": ["request", "request_line"],
    "request_length": ["request_length", "bytes_received"],
    "time_ms": ["request_time_ms", "request_time_msec", "duration_ms"],
    "time_s": ["request_time", "duration"],
    "upstream_time": ["upstream_response_time", "upstream_time"],
    "upstream_addr": ["upstream_addr", "upstream", "upstream_host"],
    "host": ["host", "http_host", "server_name", "authority"],
    "request_id": ["request_id", "req_id", "x_request_id"],
}
_GROUP = re.compile(r"(?<!\\)\((?!\?)|\(\?P?<([A-Za-z]\w*)>")

@dataclass
class Format:
    """A line format: a pattern with named groups and its time layouts."""

    pattern: str
    times: list[str] = field(default_factory=lambda: [NGINX_TIME, "iso"])
    #: Columns of what the group ``tail`` holds, by place: figures or lists parted by blanks. None where a line has less than two.
    tail: list[str] = field(default_factory=list)

    def groups(self) -> dict[str, int]:
        """Group name -> number; the first use of a name counts."""
        out: dict[str, int] = {}
        for i, m in enumerate(_GROUP.finditer(re.sub(r"(?<!\\)\[\^?\]?[^\]]*\]", lambda m: m[0].replace("(", "."), self.pattern)), 1):
            if m[1]:
                out.setdefault(m[1], i)
        return out

    def java(self) -> str:
        """Anchored, without group names (Java takes neither ``?P<`` nor ``_`` in them)."""
        p = re.sub(r"\(\?P?<[a-zA-Z]\w*>", "(", self.pattern)
        p = p if p.startswith("^") else f"^{p}"
        return p if p.endswith("$") else f"{p}.*$"


#: Some figures with commas between them, as proxies write for a request that went to several servers.
_LIST = r"[^\s,]+(?:, *[^\s,]+)*"
#: The combined log format of the web servers: client, time, request, status, size, referer, agent.
_COMMON = r'^(?<ip>\S+) \S+ \S+ \[(?<time>[^\]]+)\] "(?<request>[^"]*)" (?<status>\d{3}) (?<bytes>\d+|-)'
_COMBINED = _COMMON + r' "(?<referer>[^"]*)" "(?<ua>[^"]*)"'
#: Line formats as the servers' manuals give them; what fills no column is not kept.
FORMATS = {
    "nginx": Format(
        r'^(?<ip>\S+) - \S+ \[(?<time>[^\]]+)\] "(?<method>\S+) (?<url>[^"]+) HTTP/[\d.]+" (?<status>\d+) (?<bytes>\d+|-) "(?<referer>[^"]*)" "(?<ua>[^"]*)"(?: (?<tail>.*))?$',
        tail=["first_figure", "second_figure", "upstream_time", "upstream_addr", "host", "request_id"],
    ),
    "apache": Format(_COMBINED),
    # then requests so far, router, server and the time it took
    "traefik": Format(_COMBINED + r' \d+ "[^"]*" "[^"]*" (?<duration_ms>\d*\.?\d+)ms'),
    # time, request, code, flags, bytes in and out, duration, upstream time, forwarded-for, agent, id, authority, upstream
    "envoy": Format(
        r'^\[(?<time>[^\]]+)\] "(?<request>[^"]*)" (?<status>\d{3}) \S+ (?<request_length>\d+) (?<bytes>\d+) (?<duration>\d+) (?<upstream_time>\S+) '
        r'"(?<ip>[^"]*)" "(?<ua>[^"]*)" "(?<request_id>[^"]*)" "(?<host>[^"]*)" "(?<upstream_addr>[^"]*)"', ["iso", NGINX_TIME],
    ),
    # client, accept date, frontend, backend, timers, code, bytes, cookies, state, connections, queues, captured headers, request; syslog's words may stand in front
    "haproxy": Format(
        r'^(?:[A-Z][a-z]{2} +\d+ [\d:]{8} \S+ \S+\[\d+\]: +)?(?<ip>\S+):\d+ +\[(?<time>[^\]]+)\] +\S+ +\S+ +[\d/+-]+ +(?<status>\d{3}) +(?<bytes>\d+|-) +\S+ +\S+ +\S+ +[\d/+-]+ +[\d/-]+ +'
        r'(?:(?:-|\{[^}]*\}) +)*"(?<request>[^"]*)"', ["dd/MMM/yyyy:HH:mm:ss.SSS", NGINX_TIME, "iso"],
    ),
    # combined, then request length and time, two names in brackets, upstream address, length, time and status, id
    "nginx-ingress": Format(_COMBINED + rf" (?<request_length>\d+) (?<request_time>\d*\.?\d+) \[[^\]]*\] \[[^\]]*\] (?<upstream_addr>{_LIST}) {_LIST} (?<upstream_response_time>{_LIST}) {_LIST} (?<request_id>\S+)"),
    # date, time, server, method, stem, query, port, user, client, agent, referer, status, substatus, win32 status, time taken
    "iis": Format(
        r"^(?<time>[\d-]{10} [\d:]{8}) \S+ (?<method>\S+) (?<url>\S+) (?<query>\S+) \S+ \S+ (?<ip>\S+) (?<ua>\S+) (?<referer>\S+) (?<status>\d{3})(?: +\S+){3}\s*$", ["yyyy-MM-dd HH:mm:ss"],
    ),
    "npm": Format(
        r'^\[(?<time>[^\]]+)\] - (?<status>\d+) \d+ - (?<method>\S+) \S+ (?<host>\S+) "(?<url>[^"]+)" \[Client (?<ip>[^\]]+)\] \[Length (?<bytes>\d+)\] \[Gzip [^\]]+\] \[Sent-to (?<upstream_addr>[^\]]+)\] '
        r'"(?<ua>[^"]+)" "(?<referer>[^"]*)"',
    ),
    # fields parted by blanks, the time in brackets; or all parted by bars
    "safeline": Format(
        r'^(?<ip>[^\s|]+)(?: *- +\S+ *\[ *| *\| *\S+ *\| *)(?<time>[^\]|]*[^\]|\s])(?:\] +| *\| *)"(?<host>[^"]*)"[ |]+"(?<request>[^"]*)"[ |]+(?<status>\d{3})[ |]+(?<bytes>\d+|-)[ |]+"(?<referer>[^"]*)"[ |]+"(?<ua>[^"]*)"'
        r'(?:[ |]+"[^"]*")?\s*$',
    ),
    "zoraxy": Format(
        r"^\[?(?<time>[\d-]{10} [\d:]{8}(?:\.\d{1,9})?)\]? +\[router:[^\]]+\] +\[origin:(?<host>[^\]]*)\] +\[client: *(?<ip>[^\]]+)\] +\[useragent: *(?<ua>[^\]]*)\] +(?<method>\S+) +(?<url>\S+) +(?<status>\d{3})\s*$",
        ["yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss"],
    ),
}
ALIASES = {
    "tengine": "nginx", "httpd": "apache", "apache-httpd": "apache", "traefik-ingress": "traefik", "haproxy-ingress": "haproxy", "ingress-nginx": "nginx-ingress",
    "iis-w3c": "iis", "w3c-iis": "iis", "nginx-proxy-manager": "npm", "safeline-waf": "safeline", "raywaf": "safeline", "ray-waf": "safeline", "leichi": "safeline",
    "leichi-waf": "safeline", "zoraxy-router": "zoraxy",
}
#: Variables of a log_format: the field each fills, and what it may hold (fixed values). Others are matched and dropped.
VARIABLES = {
    "remote_addr": ("ip", "some"), "real_client_ip": ("real_client_ip", "some"), "http_x_forwarded_for": ("http_x_forwarded_for", "list"), "remote_user": ("user", "maybe"),
    "time_local": ("time", "clock"), "time_iso8601": ("time", "some"), "msec": ("time", "some"), "request": ("request", "some"), "request_method": ("method", "some"),
    "request_uri": ("url", "some"), "uri": ("url", "some"), "args": ("args", "maybe"), "query_string": ("query_string", "maybe"), "status": ("status", "three"),
    "body_bytes_sent": ("bytes", "digits"), "bytes_sent": ("bytes", "digits"), "http_referer": ("referer", "maybe"), "http_user_agent": ("ua", "maybe"),
    "host": ("host", "some"), "http_host": ("host", "some"), "server_name": ("server_name", "some"), "scheme": ("scheme", "some"), "request_length": ("request_length", "digits"),
    "remote_port": ("remote_port", "digits"), "connection": ("connection", "digits"), "request_time": ("request_time", "number"), "request_time_msec": ("request_time_msec", "number"),
    "upstream_addr": ("upstream_addr", "list"), "upstream_status": ("upstream_status", "list"), "upstream_response_time": ("upstream_response_time", "list"),
    "upstream_connect_time": ("upstream_connect_time", "list"), "upstream_header_time": ("upstream_header_time", "list"), "request_id": ("request_id", "some"),
}
ALL_TIMES = [NGINX_TIME, "iso", "yyyy-MM-dd HH:mm:ss"]


#: What a variable of a kind may hold; inside quotes, blanks too.
_BARE = {"some": r"\S+", "maybe": r"\S*", "list": _LIST, "clock": r"[^\]]+", "three": r"\d{3}", "digits": r"\d+", "number": r"\d+(?:\.\d+)?"}
_QUOTED = _BARE | {"some": r'[^"]+', "maybe": r'[^"]*', "list": f"(?:{_LIST})?"}


def log_format(text: str, *times: str) -> Format:
    """A Format from an nginx log_format string: its words are variables and what stands between them, in quotes or not."""
    words = re.findall(r"\$\w+|\$\{\w+\}|[^$]+|\$", text)
    if not any(len(w) > 1 and w[0] == "$" for w in words):
        raise ValueError("a log_format needs variables")
    made, used, quoted = [], set(), False
    for w in words:
        if w[0] != "$" or len(w) == 1:
            made.append(re.escape(w))
            quoted ^= w.count('"') % 2 == 1
            continue
        name, kind = VARIABLES.get(w.strip("${}"), ("", "maybe"))
        again = not name or name in used
        made.append(f"({'?:' if again else f'?<{name}>'}{(_QUOTED if quoted else _BARE)[kind]})")
        used.add(name)
    return checked(Format(f"^{''.join(made)}\\s*$", list(times) or ALL_TIMES))


def checked(f: Format) -> Format:
    """A format must give ip, time, status and url or request."""
    g = set(f.groups())
    have = {k for k, names in ALIASES_OF.items() if g & set(names)}
    if not {"ip", "time", "status"} <= have or not ({"url", "request"} & have):
        raise ValueError("a line format needs ip, time, status and url or request")
    return f


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(line, file): plain or gzip text by path, prefix or glob of any Hadoop file system; ``glob`` filters file names."""
    r = spark.read if glob is None else spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return r.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_manifest(spark: SparkSession, path: str, names: dict[str, str] | None = None, items: str = "items") -> DataFrame:
    """Items of a JSON index as rows; ``names`` renames its fields to path, size, mtime, etag, compressed."""
    found = spark.read.option("multiLine", True).json(path).select(F.explode(items).alias("i")).select("i.*")
    for old, new in (names or {}).items():
        found = found.withColumnRenamed(old, new)
    return found


def read_listed(spark: SparkSession, path: str, names: dict[str, str] | None = None, items: str = "items") -> DataFrame:
    """Lines of all files that a JSON index lists. The driver holds their paths, as it does for any scan."""
    paths = [r.path for r in read_manifest(spark, path, names, items).select("path").where("path is not null").distinct().collect()]
    return read_lines(spark, sorted(paths)) if paths else spark.createDataFrame([], "line string, file string")


def read_line_batches(batches: DataFrame) -> DataFrame:
    """Pushed batches (website_id, source_id, lines) as lines."""
    return batches.select("website_id", "source_id", F.explode("lines").alias("line"))


_UNITS = [("ns", 1), ("us", 10**3), ("µs", 10**3), ("μs", 10**3), ("ms", 10**6), ("s", 10**9), ("m", 60 * 10**9), ("h", 3600 * 10**9)]
_AMOUNT = r"[0-9]+(?:\.[0-9]+)?(?:ns|us|µs|μs|ms|s|m|h)"


def number_ms(n: Column, unit_ms: bool = False) -> Column:
    """A number as milliseconds: seconds, or nanoseconds over 1e9; with ``unit_ms`` milliseconds. Truncated; negative is 0."""
    return F.when(n < 0, 0).otherwise(n if unit_ms else F.when(n > 1e9, n / 1e6).otherwise(n * 1000)).cast("bigint")


def duration_ms(c: Column, unit_ms: bool = False) -> Column:
    """Duration text to milliseconds: a number, amounts with units (summed), or a comma list of them (the maximum); other text is 0."""

    def nanos(p: Column) -> Column:
        unit = F.regexp_replace(p, "[0-9.]", "")
        factor = F.lit(0)
        for name, v in _UNITS:
            factor = F.when(unit == name, v).otherwise(factor)
        return (F.regexp_replace(p, "[^0-9.]", "").cast("double") * factor).cast("bigint")

    def one(x: Column) -> Column:
        x = F.lower(F.trim(x))
        parts = F.regexp_extract_all(x, F.lit(f"({_AMOUNT})"), F.lit(1))
        total = F.aggregate(F.transform(parts, nanos), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.when(x.rlike("^[0-9.]+$"), number_ms(x.try_cast("double"), unit_ms)).when(x.rlike(f"^({_AMOUNT})+$"), F.expr("1L") * total.cast("bigint") / 1000000).cast("bigint")

    listed = F.array_max(F.transform(F.split(c, ","), one))
    return F.coalesce(F.when(c.isin("", "-"), 0).when(c.contains(","), listed).otherwise(one(c)), F.lit(0)).cast("bigint")


def clean_ip(c: Column) -> Column:
    """First of a comma list; brackets of a v6 address and a v4 port go."""
    c = F.trim(F.substring_index(c, ",", 1))
    return F.when(c.rlike(r"^[0-9.]+$"), c).otherwise(F.regexp_replace(F.regexp_replace(c, r"^\[([^\]]*)\].*$", "$1"), r"^([^:]*\.[^:]*):\d+$", "$1"))


def parse_time(c: Column, layouts: list[str], numeric: Column | None = None) -> Column:
    """Epoch seconds; digits (and points) are seconds, or milliseconds above 1e12."""
    n = c.try_cast("double")
    tries = [F.try_to_timestamp(c, F.lit(x)) if x != "iso" else c.try_cast("timestamp") for x in layouts]
    epoch = F.floor(F.when(n > 1e12, n / 1000).otherwise(n)).cast("bigint")
    return F.when(c.rlike(r"^[0-9.]+$") if numeric is None else numeric, epoch).otherwise(F.unix_seconds(F.coalesce(*tries)))


_DURATION_LIKE = r"\.|[0-9](ns|us|µs|μs|ms|s|m|h)"


def _count(c: Column) -> Column:
    return F.greatest(F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")


def _shared(get, layouts: list[str], duration_unit: str | None, extra: dict[str, Column]) -> dict[str, Column]:
    """Columns common to all formats, from raw text fields; ``__bad`` says that the format does not fit.

    ``get`` gives a field's text by column name, None where the format has none.
    """
    none = F.lit("")
    text = lambda k: none if get(k) is None else get(k)
    blank = lambda c: F.when(F.trim(c).isin("", "-"), "").otherwise(F.trim(c))
    decode = lambda c: F.when(c.rlike("[%+]"), F.coalesce(F.try_url_decode(c), c)).otherwise(c)
    parts = F.split(F.trim(text("request")), r"\s+")
    method = F.coalesce(F.get(parts, F.lit(0)), none) if get("method") is None else get("method")
    url = F.coalesce(F.get(parts, F.lit(1)), none) if get("url") is None else get("url")
    if get("query") is not None:
        q = get("query")
        url = F.when(~q.isin("", "-") & ~url.contains("?"), F.concat(url, F.lit("?"), q)).otherwise(url)
    ms, sec = get("time_ms"), get("time_s")
    time_ms = extra.get("request_time_ms", F.lit(0).cast("bigint"))
    if sec is not None:
        time_ms = duration_ms(sec, unit_ms=duration_unit == "ms")
    if ms is not None:
        time_ms = duration_ms(ms, unit_ms=True) if sec is None else F.when(ms != "", duration_ms(ms, unit_ms=True)).otherwise(time_ms)
    length = _count(text("request_length"))
    a, b = get("first_figure"), get("second_figure")
    if a is not None and b is not None:  # the figure that looks like a duration is the time, a number beside it the length
        whole = lambda c: c.rlike("^[0-9]+$")
        first, second = a.rlike(_DURATION_LIKE) & whole(b), b.rlike(_DURATION_LIKE) & whole(a)
        length = F.when(first, _count(b)).when(second, _count(a)).otherwise(0).cast("bigint")
        time_ms = duration_ms(F.when(first, a).when(second, b).otherwise(""))
    return {
        "ip": clean_ip(text("ip")), "timestamp": parse_time(text("time"), layouts, extra.get("numeric_time")), "method": method, "url": decode(url),
        "status_code": text("status").try_cast("int"), "bytes_sent": _count(text("bytes")), "request_length": length, "request_time_ms": time_ms,
        "upstream_response_time_ms": extra.get("upstream_response_time_ms", duration_ms(text("upstream_time"))), "upstream_addr": blank(text("upstream_addr")),
        "host": blank(text("host")), "request_id": blank(text("request_id")), "referer": decode(text("referer")), "ua": F.when(text("ua") == "", "-").otherwise(text("ua")), "__bad": extra.get("unmatched", F.lit(False)),
    }


def parse(lines: DataFrame, fmt: str | Format = "nginx", cutoff: int | None = None, duration_unit: str | None = None) -> DataFrame:
    """Each line with its hit's columns and ``rejected``: null, or format, ip, time, status, request or old.

    Other columns of ``lines`` are carried along. Hits before ``cutoff`` (epoch
    seconds) are old. ``duration_unit='ms'`` reads bare durations as milliseconds.
    Null lines are rejected.
    """
    return _dispatch(lines, [(None, fmt)], cutoff, duration_unit)


def _chosen(cases: list[tuple[Column | None, Column]]) -> Column | None:
    """The value of the first case whose condition holds (None: always)."""
    out = None
    for condition, value in reversed(cases):
        out = value if condition is None else F.when(condition, value) if out is None else F.when(condition, value).otherwise(out)
    return out


def _dispatch(lines: DataFrame, cases: list[tuple[Column | None, str | Format]], cutoff: int | None, duration_unit: str | None) -> DataFrame:
    """Each line by the format of the first case that it meets: one pass and one projection, in which only that format's pattern runs."""
    lines = lines.withColumn("line", F.coalesce("line", F.lit("")))
    plain = [(c, checked(f if isinstance(f, Format) else FORMATS[ALIASES.get(f, f)])) for c, f in cases if f != "caddy"]
    fields, tails = [], []
    for c, f in plain:
        n = max(f.groups().values())
        flat = F.regexp_replace(F.translate("line", SEP, " "), F.lit(f.java()), F.lit("".join(f"{SEP}${i}" for i in range(1, n + 1))))
        fields.append((c, F.split(flat, SEP)))
        if f.tail:
            tail = F.trim(F.coalesce(F.get("__f", F.lit(f.groups()["tail"])), F.lit("")))
            tails.append((c, F.when(tail == "", F.array().cast("array<string>")).otherwise(F.split(tail, r"(?<!,)\s+"))))
    m = lines
    if fields:
        m = m.withColumn("__f", _chosen(fields))
    if tails:
        m = bind(m, __t=_chosen(tails))
    json = [(c, F.from_json("line", _CADDY)) for c, f in cases if f == "caddy"]
    if json:
        m = m.withColumn("__j", _chosen(json))
    rows, at = [], iter(plain)
    for c, f in cases:
        cols = _caddy() if f == "caddy" else _matched(next(at)[1], duration_unit)
        rows.append((c, F.struct(*[v.alias(k) for k, v in cols.items()])))
    work = ("rejected", "__f", "__j", "__t")
    carried = [c for c in lines.columns if c not in cols and c not in work]
    # a generator of one row: filters on what is parsed stay above it, so nothing is parsed again for them
    out = m.select(*[F.col(f"`{c}`") for c in carried], F.inline(F.array(_chosen(rows))))
    none = F.lit("")
    bad = (
        F.when(F.col("__bad"), "format").when(F.coalesce(F.col("ip"), none) == "", "ip").when(F.col("timestamp").isNull(), "time").when(F.col("status_code").isNull(), "status")
        .when((F.coalesce(F.col("url"), none) == "") | (F.coalesce(F.col("method"), none) == ""), "request")
    )
    out = out.withColumn("rejected", bad).drop("__bad")
    return out if cutoff is None else out.withColumn("rejected", F.coalesce("rejected", F.when(F.col("timestamp") < cutoff, "old")))


def _matched(f: Format, duration_unit: str | None) -> dict[str, Column]:
    """Columns of a line that a format's pattern was applied to."""
    groups = f.groups()

    def get(column: str) -> Column | None:
        if column in f.tail:
            return F.when(F.size("__t") >= 2, F.coalesce(F.get("__t", F.lit(f.tail.index(column))), F.lit(""))).otherwise("")
        name = next((a for a in ALIASES_OF.get(column, [column]) if a in groups), None)
        return None if name is None else F.coalesce(F.get("__f", F.lit(groups[name])), F.lit(""))

    return _shared(get, f.times, duration_unit, {"unmatched": F.size("__f") != max(groups.values()) + 1})


def parse_lines(lines: DataFrame, fmt: str | Format = "nginx", cutoff: int | None = None, duration_unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, rejects with a reason) of a frame with a ``line`` column."""
    p = parse(lines, fmt, cutoff, duration_unit)
    return p.where("rejected is null").drop("rejected"), p.where("rejected is not null").select(*[F.col(f"`{c}`") for c in lines.columns], "rejected")


def parse_sources(lines: DataFrame, formats: dict[str, str | Format], default: str | Format = "nginx", source: str = "source_id", cutoff: int | None = None) -> DataFrame:
    """``parse`` with a format for each source of a site: one pass over the lines, whatever the number of formats."""
    by: list[tuple[str | Format, list[str]]] = []
    for k, f in formats.items():
        same = next((x for x in by if x[0] == f), None)
        same[1].append(k) if same else by.append((f, [k]))
    s = F.coalesce(F.col(source), F.lit(""))
    return _dispatch(lines, [*((s.isin(*names), f) for f, names in by), (None, default)], cutoff, None)


_CADDY = (
    "ts string, time string, timestamp string, status string, size string, duration string, duration_ms string, duration_ns string, remote_ip string, request_length string, "
    "upstream string, upstream_duration string, request_id string, "
    "request struct<remote_ip:string,client_ip:string,method:string,uri:string,host:string,headers:map<string,array<string>>>"
)


def _caddy() -> dict[str, Column]:
    """JSON lines. A field is a number or a text of one; the first usable of ts, time and timestamp counts."""
    at = lambda k: F.coalesce(F.col(f"__j.{k}"), F.lit(""))
    r = lambda k: F.nullif(F.col(f"__j.request.{k}"), F.lit(""))

    def header(name: str) -> Column:
        e = F.filter(F.map_entries(F.col("__j.request.headers")), lambda x: F.lower(x["key"]) == name)
        return F.coalesce(F.get(F.get(e, F.lit(0))["value"], F.lit(0)), F.lit(""))

    layouts = ["iso", NGINX_TIME]
    usable = [F.when(parse_time(c, layouts, c.try_cast("double").isNotNull()).isNotNull(), c) for c in (at("ts"), at("time"), at("timestamp"))]
    when = F.coalesce(*usable, F.lit(""))
    fields = {
        "ip": F.coalesce(r("remote_ip"), r("client_ip"), at("remote_ip")), "time": when, "method": F.coalesce(r("method"), F.lit("")), "url": F.coalesce(r("uri"), F.lit("")),
        "status": at("status"), "bytes": F.coalesce(at("size").try_cast("double").cast("bigint").cast("string"), F.lit("")), "request_length": at("request_length"),
        "upstream_addr": at("upstream"), "host": F.coalesce(r("host"), F.lit("")), "request_id": at("request_id"), "referer": header("referer"), "ua": header("user-agent"),
    }

    def amount(k: str, unit_ms: bool = False) -> Column:  # a number's text may have an exponent
        n = at(k).try_cast("double")
        return F.when(n.isNotNull(), number_ms(n, unit_ms)).when(at(k) != "", duration_ms(at(k), unit_ms))

    extra = {
        "numeric_time": when.try_cast("double").isNotNull(), "unmatched": F.col("__j.request").isNull(),
        "request_time_ms": F.coalesce(amount("duration_ms", True), amount("duration"), amount("duration_ns"), F.lit(0).cast("bigint")),
        "upstream_response_time_ms": F.coalesce(amount("upstream_duration"), F.lit(0).cast("bigint")),
    }
    return _shared(fields.get, layouts, None, extra)


def parse_report(parsed: DataFrame) -> DataFrame:
    """Per site of a ``parse`` result with site_id: accepted, rejected, first and last hit, hours seen. One pass."""
    ok, t = F.col("rejected").isNull(), F.col("timestamp")
    return parsed.groupBy("site_id").agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.min(F.when(ok, t)).alias("min_ts"), F.max(F.when(ok, t)).alias("max_ts"),
        F.count_distinct(F.when(ok, F.expr("timestamp div 3600"))).alias("hours"),
    )


def format_lines(log: DataFrame, fmt: str = "nginx") -> DataFrame:
    """Hits as lines of a format: (site_id, line). What a format has no place for is left out."""
    dash = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
    q = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    b = lambda *c: F.concat(F.lit("["), *c, F.lit("]"))
    num = lambda c: F.col(c).cast("string")
    sec = lambda c: F.format_string("%.3f", F.col(c) / 1000)
    clock = lambda layout: F.date_format(F.timestamp_seconds("timestamp"), layout)
    t, day = F.concat(clock("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000")), clock("yyyy-MM-dd HH:mm:ss")
    request, path, rest = q("method", F.lit(" "), "url", F.lit(" HTTP/1.1")), F.col("url"), F.lit("-")
    status, size, ref, ua = num("status_code"), num("bytes_sent"), q("referer"), q("browser")
    common = ["ip", F.lit("- -"), b(t), request, status, size, ref, ua]
    by = {
        "nginx": [*common, sec("request_time_ms"), num("request_length"), sec("upstream_response_time_ms"), dash("upstream_addr"), dash("host"), "request_id"],
        "apache": common,
        "traefik": [*common, F.lit('1 "app@docker" "http://10.0.0.5:8080"'), F.concat(num("request_time_ms"), F.lit(".5ms"))],
        "envoy": [b(clock("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123Z")), request, status, rest, num("request_length"), size, num("request_time_ms"), num("upstream_response_time_ms"),
                  q("ip"), ua, q("request_id"), q("host"), q("upstream_addr")],
        "haproxy": [F.lit("Apr 24 10:05:39 lb haproxy[1234]:"), F.concat("ip", F.lit(":53124")), b(clock("dd/MMM/yyyy:HH:mm:ss"), F.lit(".123")), F.lit("fe be/app1 0/0/1/12/13"), status, size,
                    F.lit("- - ---- 1/1/0/0/0 0/0"), request],
        "nginx-ingress": [*common, num("request_length"), sec("request_time_ms"), F.lit("[app-80] []"), dash("upstream_addr"), size, sec("upstream_response_time_ms"), status, "request_id"],
        "iis": [day, F.lit("10.0.0.10"), "method", path, F.lit("a=1&b=2 443 -"), "ip", "browser", dash("referer"), status, F.lit("0 0"), num("request_time_ms")],
        "npm": [b(t), rest, status, F.lit("502 -"), "method", F.lit("http"), dash("host"), q(path), b(F.lit("Client "), "ip"), b(F.lit("Length "), size), F.lit("[Gzip -] [Sent-to 10.0.0.4]"), ua, ref],
        "safeline": ["ip", F.lit("- -"), b(t), q("host"), request, status, size, ref, ua, F.lit('"-"')],
        "zoraxy": [b(day, F.lit(".123456")), F.lit("[router:host-http]"), b(F.lit("origin:"), "host"), b(F.lit("client: "), "ip"), b(F.lit("useragent: "), "browser"), "method", path, status],
        "caddy": [F.to_json(F.struct(
            (F.col("timestamp") + 0.25).alias("ts"), F.struct(F.col("ip").alias("remote_ip"), "method", F.col("url").alias("uri"), "host", F.struct(
                F.array("browser").alias("User-Agent"), F.array("referer").alias("Referer")).alias("headers")).alias("request"),
            F.col("status_code").alias("status"), F.col("bytes_sent").alias("size"), "request_length", F.col("request_time_ms").alias("duration_ms"), F.col("upstream_addr").alias("upstream"), "request_id"))],
    }
    return log.select("site_id", F.concat_ws(" ", *by[fmt]).alias("line"))


def write_hits(log: DataFrame, path: str) -> None:
    """Append hits partitioned by site and day; Spark splits a large day over several files and puts small ones in one task."""
    d = log.withColumn("day", F.to_date(F.timestamp_seconds("timestamp")))
    d.hint("rebalance", "site_id", "day").write.mode("append").partitionBy("site_id", "day").parquet(path)
