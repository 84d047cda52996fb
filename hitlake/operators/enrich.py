"""Page-view flag, hosts, watch lists, alerts, user agents, IP location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basics import bind

#: Paths that are not page views unless configured otherwise (fixed values).
EXCLUDED_PATHS = [
    "favicon.ico$",
    "robots.txt$",
    "sitemap.xml$",
    r"\.(?:js|css|jpg|jpeg|png|gif|svg|webp|woff|woff2|ttf|eot|ico)$",
    "^/api/",
    "^/ajax/",
    "^/health$",
    "^/_(?:nuxt|next)/",
    "rss.xml$",
    "feed.xml$",
    "atom.xml$",
]


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Loopback, link-local (unicast and multicast) and private addresses; a v6 group that names a range has all four digits (fixed values).
_PRIVATE = "|".join([
    rf"^(?:::ffff:)?(?:(?:10|127)(?:\.{_OCTET}){{3}}|(?:192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))(?:\.{_OCTET}){{2}}|224\.0\.0\.{_OCTET})$",
    r"^(?:f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]|ff[0-9a-f]2):[0-9a-f:]*$", r"^(?:::|(?:0+:){7})0*1$",
])


def ip_number(c: Column) -> Column:
    """IPv4 text as a number; null where it is not IPv4."""
    packed = F.aggregate(F.split(c, r"\."), F.lit(0).cast("bigint"), lambda n, p: n * 256 + p.cast("bigint"))
    return F.when(c.rlike(_V4), packed)


def ip_key(c: Column) -> Column:
    """An address as 32 hex digits, which sort as addresses do; IPv4 lies in ::ffff:0:0/96. Null where it is no address."""
    v4 = F.when(c.rlike(_V4), c).when(F.lower(c).rlike(rf"^::ffff:{_V4[1:]}"), F.substring_index(c, ":", -1))
    low = F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(ip_number(v4)), 8, "0")))
    halves = F.split(F.lower(c), "::")
    part = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    missing = 8 - F.size(part(0)) - F.size(part(1))
    full = F.concat(part(0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), part(1))
    sound = F.lower(c).rlike("^(?!.*::.*::)(?!:[^:])(?!.*[^:]:$)(?=.*:)(?:[0-9a-f]{1,4}|:)+$") & F.when(c.contains("::"), missing >= 1).otherwise(missing == 0) & F.forall(full, lambda x: F.length(x) <= 4)
    v6 = F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), "")
    return F.when(v4.isNotNull(), low).when(F.coalesce(sound, F.lit(False)), v6)


def is_private_ip(c: Column) -> Column:
    """Private, loopback or link-local, v4 and v6."""
    return F.coalesce(F.lower(c).rlike(_PRIVATE), F.lit(False))


def flag_pageviews(log: DataFrame, statuses: list[int] = (200,), patterns: list[str] = EXCLUDED_PATHS, exclude_ips: list[str] | None = None) -> DataFrame:
    """Status listed, address public (unless exclude_ips is an explicit empty list) and not excluded, no pattern in the url.

    Patterns look at the decoded url as it is, letter case and query included: ``/a.css?v=1`` is a page view.
    """
    path = F.coalesce(F.try_url_decode(F.col("url")), F.col("url"))
    ok = F.coalesce(F.col("status_code").isin(*statuses), F.lit(False))
    if patterns:
        ok = ok & ~F.coalesce(path.rlike("|".join(f"(?:{x})" for x in patterns)), F.lit(False))
    if exclude_ips is None or exclude_ips:
        ok = ok & ~is_private_ip(F.col("ip"))
    if exclude_ips:
        ok = ok & ~F.col("ip").isin(*exclude_ips)
    return log.withColumn("pageview_flag", ok.cast("int"))


def normalize_host(c: Column) -> Column:
    c = F.lower(F.trim(c))
    for pattern, to in ((r"^[a-z][a-z0-9+.-]*://", ""), (r"[/?#].*$", ""), (r"^.*@", ""), (r":\d+$", ""), (r"^\*\.", ""), (r"\.+$", "")):
        c = F.regexp_replace(c, pattern, to)
    return c


def filter_hosts(log: DataFrame, domains: list[str]) -> DataFrame:
    """Hits whose host is a domain or below one; an empty host, or no domains, keeps all."""
    if not domains:
        return log
    h = normalize_host(F.col("host"))
    ok = h == ""
    for d in domains:
        ok = ok | (h == d) | h.endswith("." + d)
    return log.where(ok)


def discover_hosts(log: DataFrame, source: str | None = None) -> DataFrame:
    """Distinct valid hosts (of each source), each a site of its own; an address is valid too."""
    keys = [source] if source else []
    h = log.select(*keys, F.regexp_replace(normalize_host(F.col("host")), r"^\[|\]$", "").alias("host")).distinct()
    ok = (F.length("host") <= 255) & (F.col("host").rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$") | ip_key(F.col("host")).isNotNull())
    return h.where(ok).select(*keys, "host", F.substring(F.md5("host"), 1, 4).alias("site_id"))


def sanitize(c: Column, limit: int) -> Column:
    """No NUL, '?' for runs of invalid UTF-8, at most ``limit`` bytes on a character boundary."""
    c = F.make_valid_utf8(c)
    c = F.replace(F.when(c.contains("\ufffd"), F.regexp_replace(c, "\ufffd+", "?")).otherwise(c), F.lit("\u0000"), F.lit(""))
    # a character of 2 to 4 bytes that the limit cuts has lost its end: its lead byte and what follows go
    cut = F.regexp_replace(F.hex(F.substring(F.encode(c, "UTF-8"), 1, limit)), "^((?:..)*?)(?:[CD].|E.(?:..)?|F.(?:..){0,2})$", "$1")
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(F.unhex(cut), "UTF-8"))


#: Bytes that a text column may hold (fixed values).
LIMITS = {"url": 2000, "referer": 2000, "browser": 256, "os": 256, "device": 256, "host": 255, "request_id": 256, "upstream_addr": 512}


def sanitize_hits(log: DataFrame) -> DataFrame:
    """Text columns of hits cleaned and cut to what may be stored."""
    return log.select(*[sanitize(F.col(c), LIMITS[c]).alias(c) if c in LIMITS else F.col(f"`{c}`") for c in log.columns])


#: Copies of one line that a task numbers together.
RUN = 100_000


def line_fingerprints(lines: DataFrame, source: str, file: str | None = None) -> DataFrame:
    """``lines`` with copy and fingerprint: stable over re-reads; the k-th copy of a line in its file has its own.

    Copies are rows with equal columns, so they are counted, not moved: a count is
    dealt out in runs and unrolled to rows again. A common line is no hot task.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = lines.groupBy(*lines.columns).agg(F.count("*").alias("__n"))
    runs = counted.withColumn("__run", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"), F.lit(RUN).cast("long")))).repartition(n, "line", "__run")
    out = runs.withColumn("copy", F.explode(F.sequence(F.col("__run"), F.least(F.col("__run") + RUN - 1, "__n")))).drop("__n", "__run")
    keys = [file] if file else []
    parts = [F.lit(source), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys], F.col("copy").cast("string"), F.coalesce("line", F.lit(""))]
    return out.withColumn("fingerprint", F.sha1(F.concat_ws("\u0001", *parts).cast("binary")))


def stream_fingerprints(lines: DataFrame) -> DataFrame:
    """Pushed lines (source_id, line) with a fingerprint: equal lines of a source are the same hit."""
    parts = [F.lit("stream:v1"), F.coalesce(F.col("source_id").cast("string"), F.lit("")), F.coalesce("line", F.lit(""))]
    return lines.withColumn("fingerprint", F.sha1(F.concat_ws("\u0000", *parts).cast("binary")))


# user agents: ordered rules, first match wins (fixed values)
BOT = r"bot|spider|crawl|slurp|curl|wget|python-requests|go-http-client"
BROWSERS = [("Edge", r"edg(e|a|ios)?/"), ("Opera", r"opr/|opera"), ("Firefox", r"firefox/|fxios/"), ("Chrome", r"chrome/|crios/"), ("Safari", r"safari/"), ("IE", r"msie |trident/")]
SYSTEMS = [("Windows", "windows"), ("iOS", r"iphone|ipad|ipod"), ("Android", "android"), ("macOS", "mac os x|macintosh"), ("Linux", "linux")]


def _first(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def classify_user_agents(log: DataFrame, column: str = "ua") -> DataFrame:
    """Set browser, os, device: rules run once per distinct agent, then join back. A null agent is as an empty one.

    Device: bot, apple (a native client's CFNetwork and Darwin, which name no system: the
    browser is the program's name), tablet, mobile, desktop or other.
    """
    u = F.lower(F.coalesce(F.col(column), F.lit("")))
    bot, native = u.rlike(BOT), u.contains("cfnetwork/") & u.contains("darwin/")
    device = F.when(native, "apple").when(u.rlike("ipad|tablet|android(?!.*mobile)"), "tablet").when(u.rlike("mobile|iphone|ipod"), "mobile").when(u.rlike("windows|macintosh|linux|x11"), "desktop").otherwise("other")
    program = F.regexp_extract(F.col(column), r"^\s*([^/\s]+)/", 1)
    browser = F.when(native & (program != "") & ~u.startswith("mozilla/"), program).otherwise(_first(u, BROWSERS, "other"))
    d = log.select(column).distinct().select(
        F.col(column).alias("__ua"), *[F.when(bot, "bot").otherwise(e).alias(n) for n, e in (("browser", browser), ("os", _first(u, SYSTEMS, "other")), ("device", device))]
    )
    return log.drop("browser", "os", "device").join(d, F.col(column).eqNullSafe(F.col("__ua")), "left").drop("__ua")


#: Words in the domestic location of hits from China that lie off the mainland (fixed values).
OFF_MAINLAND = ["香港", "澳门", "台湾", "台北", "台中", "台南", "高雄", "新北", "桃园", "基隆", "嘉义", "新竹", "屏东"]
#: Endings of place names, the first that fits is cut (fixed values).
PLACE_ENDINGS = ["特别行政区", "自治区", "维吾尔自治区", "回族自治区", "壮族自治区", "省", "市", "地区", "盟", "州", "县", "区"]
UNKNOWN_NAMES = ["", "unknown", "未知"]


def is_china(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("china", "cn", "中国")


def is_non_mainland(domestic: Column, global_: Column) -> Column:
    """Known to lie abroad, or in China off the mainland; pending and unknown locations are neither."""
    known = lambda c: ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*UNKNOWN_NAMES, "pending")
    return F.coalesce(known(global_) & (~is_china(global_) | (known(domestic) & domestic.rlike("|".join(OFF_MAINLAND)))), F.lit(False))


def cut_ending(c: Column, endings: list[str], least: int = 0) -> Column:
    """A name without the first of ``endings`` that it has, where ``least`` characters or more are left.

    An ending that ends as one before it does is never the first; of the others the longest that fits is.
    """
    first = [e for i, e in enumerate(endings) if not any(e.endswith(x) for x in endings[:i])]
    return F.regexp_replace(c, f"(?<=.{{{least}}})(?:{'|'.join(first)})$", "")


def normalize_city(c: Column) -> Column:
    """A place's name for comparing: no blanks, dots or hyphens, lower case, without its ending; unknown is empty."""
    clean = F.lower(F.regexp_replace(F.trim(c), "[· -]", ""))
    return F.when(F.trim(c).isin(*UNKNOWN_NAMES), "").otherwise(cut_ending(clean, PLACE_ENDINGS))


def address_ranges(rules: DataFrame) -> DataFrame:
    """Address rules (rule_type ip, cidr or range; value) with lo and hi, hex keys of their first and last address."""
    v, typ = F.trim("value"), F.col("rule_type")
    first = F.trim(F.when(typ == "cidr", F.substring_index(v, "/", 1)).when(typ == "range", F.substring_index(v, "-", 1)).otherwise(v))
    last = F.trim(F.when(typ == "range", F.substring_index(v, "-", -1)).otherwise(first))
    bits = F.substring_index(v, "/", -1).try_cast("int") + F.when(first.contains(":"), 0).otherwise(96)
    r = bind(rules, __first=first, __last=last, __bits=F.when(typ == "cidr", bits).otherwise(128))
    r = bind(r, __a=ip_key(F.col("__first")), __b=ip_key(F.col("__last")))
    q = F.least(F.expr("__bits div 4"), F.lit(31))
    span = F.pow(F.lit(2.0), (q + 1) * 4 - F.col("__bits")).cast("int")
    digit = F.conv(F.substring(F.col("__a"), q + 1, F.lit(1)), 16, 10).cast("int")
    low = digit - digit % span
    edge = lambda d, fill: F.concat(F.left("__a", q), F.lower(F.hex(d)), F.repeat(F.lit(fill), 31 - q))
    net = (typ == "cidr") & F.col("__bits").between(0, 128)
    lo = F.when(net, edge(low, "0")).when(typ.isin("ip", "range"), F.col("__a"))
    hi = F.when(net, edge(low + span - 1, "f")).when(typ.isin("ip", "range"), F.col("__b"))
    same_kind = F.col("__a").startswith("0" * 20 + "ffff") == F.col("__b").startswith("0" * 20 + "ffff")
    return bind(r, lo=lo, hi=hi, __same=same_kind).where((F.col("lo") <= F.col("hi")) & F.col("__same")).drop("__first", "__last", "__a", "__b", "__bits", "__same")


def inside(addresses: DataFrame, nets: DataFrame, keys: list[str]) -> DataFrame:
    """Addresses (keys, __key) joined to the ranges (keys, lo, hi) that hold them.

    A range lies under the hex digits that its first and last address share, so an address
    meets ranges by an equi join on those digits, once for each number of digits that any range
    has (33 at most). It is for distinct addresses, not for hits.
    """
    same = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(F.col("lo"), i, F.lit(1)) == F.substring(F.col("hi"), i, F.lit(1))), i).otherwise(n))
    led = bind(nets, __digits=same).withColumn("__lead", F.expr("left(lo, __digits)"))
    levels = sorted(x[0] for x in led.select("__digits").distinct().collect())
    at = addresses.where("__key is not null")
    at = at.withColumn("__digits", F.explode(F.array(*map(F.lit, levels)))) if levels else at.withColumn("__digits", F.lit(0)).where("false")
    return at.withColumn("__lead", F.expr("left(__key, __digits)")).join(led, [*keys, "__digits", "__lead"]).where("__key between lo and hi").drop("__digits", "__lead")


def match_watchlist(log: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule per hit, by kind: ip, cidr, range, city, non_mainland; then by value.

    Rules: (site_id, rule_type, value). Address rules are matched with a site's distinct addresses,
    city rules with its distinct locations; hits only look up what was found for theirs.
    """
    order = F.when(F.col("rule_type") == "ip", 1).when(F.col("rule_type") == "cidr", 2).when(F.col("rule_type") == "range", 3).when(F.col("rule_type") == "city", 4).otherwise(5)
    r = rules.select("site_id", "rule_type", "value", order.alias("order"))
    found = lambda name: F.min(F.struct("order", "rule_type", "value")).alias(name)
    ips = bind(log.select("site_id", "ip").distinct(), __key=ip_key(F.col("ip")))
    by_ip = inside(ips, address_ranges(r.where("order <= 3")), ["site_id"]).groupBy("site_id", "ip").agg(found("__ip"))
    places = log.select("site_id", "domestic").distinct().withColumn("place", normalize_city(F.col("domestic")))
    cities = r.where("order = 4").withColumn("city", normalize_city(F.col("value"))).where("city <> ''")
    by_city = places.join(cities, "site_id").where("contains(place, city)").groupBy("site_id", "domestic").agg(found("__city"))
    by_far = r.where("order = 5").groupBy("site_id").agg(found("__far"))
    j = log.join(by_ip, ["site_id", "ip"], "left").join(by_city, ["site_id", "domestic"], "left").join(by_far, "site_id", "left")
    far = F.when(is_non_mainland(F.col("domestic"), F.col("global")), F.col("__far"))
    rule = F.array_min(F.array_compact(F.array("__ip", "__city", far)))
    m = bind(j.select(*[F.col(f"`{c}`") for c in log.columns], "__ip", "__city", "__far"), __rule=rule).where("__rule is not null")
    return m.select(*[F.col(f"`{c}`") for c in log.columns], F.col("__rule.rule_type").alias("rule_type"), F.col("__rule.value").alias("rule_value"))


def watchlist_hits(log: DataFrame, rules: DataFrame) -> DataFrame:
    m = match_watchlist(log, rules)
    at = F.struct("timestamp", "id")
    g = m.groupBy("site_id", "rule_type", "rule_value", "ip").agg(F.count("*").alias("hits"), F.min("timestamp").alias("first_ts"), F.min_by("url", at).alias("first_url"))
    return g.withColumn("fingerprint", F.sha1(F.concat_ws("|", "site_id", "rule_type", "rule_value", "ip").cast("binary")))


def rollup_alerts(alerts: DataFrame) -> DataFrame:
    """Rows of one fingerprint merge: occurrences add, the latest text wins, and the alert is unread; without one they stay, unread too."""
    last = F.struct("last_occurred_at", "message")
    g = alerts.where("fingerprint is not null").groupBy("fingerprint").agg(
        F.sum("occurrences").alias("occurrences"), F.max("last_occurred_at").alias("last_occurred_at"), F.max_by("message", last).alias("message")
    )
    alone = alerts.where("fingerprint is null").select("fingerprint", F.col("occurrences").cast("long").alias("occurrences"), "last_occurred_at", "message")
    return g.unionByName(alone).withColumn("unread", F.lit(True))


def upsert_alerts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored alerts (as ``rollup_alerts`` gives them) with new ones: an alert that comes again is unread again, others keep their state."""
    fresh = rollup_alerts(new)
    cols = ["fingerprint", "occurrences", "last_occurred_at", "message", "unread"]
    both = stored.select(*cols).unionByName(fresh.select(*cols))
    last = F.struct("last_occurred_at", "message")
    g = both.where("fingerprint is not null").groupBy("fingerprint").agg(
        F.sum("occurrences").alias("occurrences"), F.max("last_occurred_at").alias("last_occurred_at"), F.max_by("message", last).alias("message"), F.bool_or("unread").alias("unread")
    )
    return g.unionByName(both.where("fingerprint is null"))


def list_alerts(alerts: DataFrame, page: int = 1, size: int = 20, unread_only: bool = False) -> DataFrame:
    """A page, newest first, with has_more and the number of unread alerts in all."""
    kept = alerts.where("unread") if unread_only else alerts
    rows = kept.orderBy(F.desc("last_occurred_at"), "message").offset((page - 1) * size).limit(size + 1)
    w = Window.orderBy(F.desc("last_occurred_at"), "message")  # size + 1 rows
    shown = rows.withColumn("__n", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size).where(F.col("__n") <= size).drop("__n")
    return shown.join(F.broadcast(alerts.agg(F.count_if("unread").alias("unread_count"))))  # one row


def locate_ips(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, domestic, global, has_city): fixed answers, then the narrowest range of the table (lo, hi, region) that holds the address.

    lo and hi are numbers, which only IPv4 has and which are looked up by their upper 16 bits,
    or addresses of either kind as text.
    """
    c = F.col("ip")
    fixed = F.when(c.isin("127.0.0.1", "::1", "localhost"), "local").when(is_private_ip(c), "intranet").when(~c.rlike(_V4) & ~c.contains(":"), "unknown")
    d = bind(ips.select("ip").distinct(), n=ip_number(c), fixed=fixed)
    if dict(ranges.dtypes)["lo"] == "string":
        nets = bind(ranges.select("region", F.col("lo").alias("a"), F.col("hi").alias("b")), lo=ip_key(F.col("a")), hi=ip_key(F.col("b"))).where("lo <= hi").select("lo", "hi", "region")
        held = inside(bind(d.where("fixed is null"), __key=ip_key(c)), nets, [])
        # of ranges that nest the narrowest begins last, and of those that begin alike it ends first
        hit = held.groupBy("ip", "lo").agg(F.min_by("region", "hi").alias("region")).groupBy("ip").agg(F.max_by("region", "lo").alias("region"))
    else:
        r = ranges.withColumn("b", F.explode(F.sequence(F.expr("lo div 65536"), F.expr("hi div 65536"))))
        hit = d.where("fixed is null").withColumn("b", F.expr("n div 65536")).join(r, "b").where("n between lo and hi").groupBy("ip").agg(F.min_by("region", F.expr("hi - lo")).alias("region"))
    j = d.join(hit, "ip", "left")
    dom, glo, city = parse_region(F.col("region"))
    return j.select(
        "ip", F.coalesce("fixed", dom, F.lit("unknown")).alias("domestic"), F.coalesce("fixed", glo, F.lit("unknown")).alias("global"), F.coalesce(city, F.lit(False)).alias("has_city")
    )


def _part(c: Column) -> Column:
    """A part of a place's name: null where blank, 0 or unknown."""
    c = F.trim(c)
    return F.when(~c.isin("0", *UNKNOWN_NAMES), c)


def parse_region(c: Column) -> tuple[Column, Column, Column]:
    """country|area|province|city|carrier -> (domestic, global, has_city); '0' and '' are blank, an unknown country is null.

    Where the carrier stands in the city's place, province and city stand one place earlier.
    Only 中国 has its endings cut and its city without carriers; elsewhere the parts stay as they are.
    """
    p = F.split(c, r"\|")
    part = [F.trim(F.coalesce(F.get(p, F.lit(i)), F.lit(""))) for i in range(5)]
    country, early = part[0], ~is_carrier(part[4]) & is_carrier(part[3]) & ~is_carrier(part[2])
    province, city = F.when(early, part[1]).otherwise(part[2]), F.when(early, part[2]).otherwise(part[3])
    own_city = strip_suffix(city)
    own_city = F.when(is_carrier(own_city) | own_city.isin("", "0"), None).otherwise(own_city)
    own = strip_suffix(province)
    home = F.when(~own.isin("", "0"), F.when(own_city.isNotNull() & (own_city != own), F.concat_ws("·", own, own_city)).otherwise(own)).otherwise(F.coalesce(own_city, F.lit("中国")))
    there = F.concat_ws("·", _part(country), _part(province), _part(city))
    known = ~country.isin("", "0")
    domestic = F.when(country == "中国", home).when(known, F.when(there != "", there))
    return domestic, F.when(known, country), F.coalesce(own_city != "未知", F.lit(False))


def format_location(country: Column, code: Column, region: Column, city: Column) -> tuple[Column, Column]:
    """(domestic, global) labels of a lookup's columns: in China province·city without endings, each once; elsewhere country·region·city."""
    blank = lambda c: F.when(c != "", c)
    known, r, t = F.when(~F.trim(country).isin("", "0"), F.trim(country)), _part(region), _part(city)
    home = is_china(country) | (F.lower(F.trim(code)) == "cn")
    province, town = strip_suffix(r), strip_suffix(t)
    own = F.when(province.eqNullSafe(town), province).otherwise(blank(F.concat_ws("·", province, town)))
    there = blank(F.concat_ws("·", _part(country), r, t))
    domestic = F.when(known.isNull(), None).when(F.coalesce(home, F.lit(False)), F.coalesce(own, known)).otherwise(there)
    return F.coalesce(domestic, F.lit("unknown")), F.coalesce(known, F.lit("unknown"))


#: Endings of regions, the first that fits is cut; carriers; names of data centres and clouds (fixed values).
SUFFIXES = ["省", "市", "自治区", "维吾尔自治区", "壮族自治区", "回族自治区", "特别行政区"]
CARRIERS = ["电信", "联通", "移动", "铁通", "广电", "网通", "教育网", "长城宽带", "有线", "鹏博士"]
#: Endings of places, which are no carriers (fixed values).
REGIONS = ["省", "市", "自治区", "地区", "盟", "州", "县", "区", "特别行政区"]
DATACENTERS = [
    "机房", "idc", "data center", "datacenter", "数据中心", "腾讯", "阿里", "百度", "华为", "京东", "字节", "火山", "金山", "青云", "ucloud", "aws", "azure", "gcp",
]
#: Provinces by the start of their name (fixed values).
PROVINCES = [
    "北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "海南", "四川", "贵州",
    "云南", "陕西", "甘肃", "青海", "台湾", "内蒙古", "广西", "西藏", "宁夏", "新疆", "香港", "澳门",
]


def strip_suffix(c: Column) -> Column:
    """A name without its ending; a name that is nothing else stays."""
    return cut_ending(c, SUFFIXES, 1)


def is_carrier(c: Column) -> Column:
    """A carrier's name; what ends as a place does is none."""
    place = F.trim(c).rlike(f"(?:{'|'.join(REGIONS)})$")
    return F.coalesce(~place & F.trim(c).rlike("|".join(CARRIERS)), F.lit(False))


def province_of(c: Column) -> Column:
    """The province that the first fitting word of a text begins with, else null."""
    words = F.transform(F.split(F.trim(c), r"[·/\\\-_|,，;；()（）\[\]{}\s]+"), lambda w: F.regexp_extract(w, f"^(?:中国)?({'|'.join(PROVINCES)}|内蒙)", 1))
    found = F.get(F.filter(words, lambda w: w != ""), F.lit(0))
    return F.when(found == "内蒙", "内蒙古").otherwise(found)


def normalize_location(domestic: Column, global_: Column) -> Column:
    """The domestic label of a place in China without carriers, each part once; a data centre becomes its province, or one label.

    Labels of other countries, and empty ones, stay.
    """
    carriers = "|".join(CARRIERS)
    parts = F.transform(F.split(F.trim(domestic), "·"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), carriers, ""), r"^[-_/|,，;；()（）\[\]{}\s]+|[-_/|,，;；()（）\[\]{}\s]+$", ""))
    clean = F.array_join(F.array_distinct(F.filter(parts, lambda x: ~x.isin("0", *UNKNOWN_NAMES) & ~is_carrier(x))), "·")
    center = F.lower(domestic).rlike("|".join(DATACENTERS))
    out = F.when(center, F.coalesce(province_of(domestic), province_of(clean), F.lit("机房"))).when(clean == "", F.trim(global_)).otherwise(clean)
    return F.when(is_china(global_) & (F.trim(domestic) != ""), out).otherwise(F.trim(domestic))


def effective_location(ips: DataFrame, overrides: DataFrame, cache: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Override over cache over lookup over pending."""
    j, dom, glo = ips.select("ip").distinct(), [], []
    for i, df in enumerate(x for x in (overrides, cache, lookups) if x is not None):
        j = j.join(df.select("ip", F.col("domestic").alias(f"d{i}"), F.col("global").alias(f"g{i}")), "ip", "left")
        dom.append(f"d{i}"), glo.append(f"g{i}")
    return j.select("ip", F.coalesce(*dom, F.lit("pending")).alias("domestic"), F.coalesce(*glo, F.lit("pending")).alias("global"))


def choose_location(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local with a city, else remote if known, else local, else unknown. Both: ip, domestic, global; local also has_city."""
    r = remote.select("ip", F.col("domestic").alias("rd"), F.col("global").alias("rg"))
    j = local.join(r, "ip", "full")
    known = F.coalesce(~F.col("rg").isin(*UNKNOWN_NAMES), F.lit(False))
    use = F.when(F.coalesce("has_city", F.lit(False)), 0).when(known, 1).otherwise(0)
    return j.select("ip", *[F.coalesce(F.when(use == 1, F.col(a)).otherwise(F.col(b)), F.lit("unknown")).alias(b) for a, b in (("rd", "domestic"), ("rg", "global"))])


def _usable(cache: DataFrame) -> DataFrame:
    return cache.where("not (domestic in ('unknown', '未知') and global in ('unknown', '未知'))")


def pending_ips(log: DataFrame, cache: DataFrame) -> DataFrame:
    return log.select("ip").distinct().join(_usable(cache).select("ip"), "ip", "left_anti")


def retryable_ips(pending: DataFrame, failures: DataFrame, cutoff, n: int) -> DataFrame:
    """Pending ips (ip, created_at) without a failure since cutoff, oldest first."""
    recent = failures.where(F.col("created_at") >= cutoff).select("ip")
    return pending.join(recent, "ip", "left_anti").orderBy("created_at", "ip").limit(n)


def apply_locations(rows: DataFrame, located: DataFrame) -> DataFrame:
    """Set the location of hits or sessions still pending."""
    new = located.select("ip", F.col("domestic").alias("nd"), F.col("global").alias("ng"))
    j = rows.join(new, "ip", "left")
    use = (F.col("domestic") == "pending") & F.col("nd").isNotNull()
    new = {"domestic": F.when(use, F.col("nd")).otherwise(F.col("domestic")), "global": F.when(use, F.col("ng")).otherwise(F.col("global"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def _moved(rows: DataFrame, ip: str, domestic: str, global_: str) -> DataFrame:
    me = F.col("ip") == ip
    return rows.withColumn("domestic", F.when(me, domestic).otherwise(F.col("domestic"))).withColumn("global", F.when(me, global_).otherwise(F.col("global")))


def override_location(log: DataFrame, sessions: DataFrame, ip: str, domestic: str, global_: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits and sessions with the ip relocated, one row: hits, sessions and sites touched)."""
    me = F.col("ip") == ip
    touched = log.where(me).agg(F.count("*").alias("hits"), F.count_distinct("site_id").alias("sites"))
    report = touched.join(F.broadcast(sessions.where(me).agg(F.count("*").alias("sessions"))))  # one row each
    return _moved(log, ip, domestic, global_), _moved(sessions, ip, domestic, global_), report.select("hits", "sessions", "sites")


def mark_pending(log: DataFrame, sessions: DataFrame, cache: DataFrame, ip: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ip waits for a location again: (hits, sessions, the cache without it)."""
    return _moved(log, ip, "pending", "pending"), _moved(sessions, ip, "pending", "pending"), cache.where(F.col("ip") != ip)


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New rows win; both (ip, domestic, global, source, created_at). Domestic labels are normalised, a blank source is 'unknown'."""
    fresh = new.withColumn("domestic", normalize_location(F.col("domestic"), F.col("global")))
    if "source" in new.columns:
        fresh = fresh.withColumn("source", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")))
    return fresh.unionByName(cache.join(new.select("ip"), "ip", "left_anti"))


def trim_cache(cache: DataFrame, n: int) -> DataFrame:
    return cache.orderBy(F.desc("created_at"), "ip").limit(n)


def _failures(failures: DataFrame, reason: str | None, keyword: str | None, site_ips: DataFrame | None) -> DataFrame:
    f = failures
    if site_ips is not None:
        f = f.join(site_ips.select("ip").distinct(), "ip", "left_semi")
    if reason:
        f = f.where(F.col("reason") == reason)
    if keyword:
        f = f.where(F.contains(F.lower("ip"), F.lit(keyword.lower())) | F.contains(F.lower("error"), F.lit(keyword.lower())))
    return f


def list_geo_failures(failures: DataFrame, reason: str | None = None, keyword: str | None = None, site_ips: DataFrame | None = None, n: int = 50) -> DataFrame:
    """Newest first, one more than a page of n where there are more."""
    return _failures(failures, reason, keyword, site_ips).orderBy(F.desc("created_at"), F.desc("id")).limit(n + 1)


def geo_failure_rows(failures: DataFrame, site: str = "all", reason: str | None = None, keyword: str | None = None, site_ips: DataFrame | None = None) -> DataFrame:
    """Failures as exported: website, ip, reason, source, error, status_code, created_at (RFC 3339)."""
    f = _failures(failures, reason, keyword, site_ips)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    when = F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return f.select(F.lit(site).alias("website"), "ip", "reason", text("source").alias("source"), text("error").alias("error"), text("status_code").alias("status_code"), when.alias("created_at"))


def export_geo_failures(failures: DataFrame, path: str, **filters) -> None:
    """All failures that the filters leave as CSV: one distributed job."""
    geo_failure_rows(failures, **filters).write.mode("overwrite").option("header", True).csv(path)


def drop_geo_failures(failures: DataFrame, resolved: DataFrame | None = None, reason: str | None = None, keyword: str | None = None, site_ips: DataFrame | None = None) -> DataFrame:
    """Failures without those of resolved ips, and without those that the filters select (where any is given)."""
    out = failures if resolved is None else failures.join(resolved.select("ip").distinct(), "ip", "left_anti")
    if reason or keyword or site_ips is not None:
        out = out.join(_failures(failures, reason, keyword, site_ips).select("id"), "id", "left_anti")
    return out


def resolve_batch(pending: DataFrame, cache: DataFrame, lookups: DataFrame, failed: DataFrame, request_failed: bool = False) -> dict[str, DataFrame]:
    """One step of resolving pending ips, as tables.

    ``lookups`` (ip, domestic, global, source) and ``failed`` (ip, reason) are the answers
    to this batch's questions; ``request_failed`` says that the lookups broke off. An ip
    with a usable cached location takes it; else its lookup; else it stays pending if it
    failed or the lookups broke off; else it is unknown. Returns resolved (ip, domestic, global,
    source), cache_new (answers to store), cache_dropped (unknown entries to forget), failures
    (ip, reason) and pending (what is left).
    """
    p = pending.select(F.trim("ip").alias("ip")).where("ip <> ''").distinct()
    c = _usable(cache).select("ip", F.struct("domestic", "global", F.lit("cache").alias("source")).alias("c"))
    look = lookups.select("ip", F.struct(normalize_location(F.col("domestic"), F.col("global")).alias("domestic"), "global", "source").alias("l"))
    why = failed.groupBy("ip").agg(F.min("reason").alias("reason"))
    j = p.join(c, "ip", "left").join(look, "ip", "left").join(why, "ip", "left")
    none = F.struct(F.lit("unknown").alias("domestic"), F.lit("unknown").alias("global"), F.lit("unknown").alias("source"))
    stay = F.lit(request_failed) | F.col("reason").isNotNull()
    j = j.withColumn("got", F.coalesce("c", "l", F.when(~stay, none)))
    open_ = j.where("got is null")
    return {
        "resolved": j.where("got is not null").select("ip", "got.*"),
        "cache_new": j.where("c is null and l is not null").select("ip", "l.*"),
        "cache_dropped": cache.where("domestic in ('unknown', '未知') and global in ('unknown', '未知')").join(p, "ip", "left_semi").select("ip"),
        "failures": j.where("c is null and l is null").where(stay).select("ip", F.coalesce("reason", F.lit("request_error")).alias("reason")),
        "pending": open_.select("ip"),
    }
