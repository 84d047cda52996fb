"""Small tables for addresses, hosts, agents, locations, times and the export."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hitlake.functions import timeutil as T
from hitlake.operators import enrich as E
from hitlake.operators import logs as L


def one(spark, cases, f):
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    return {r.x: r.y for r in df.select("x", f(F.col("x")).alias("y")).collect()}


def test_addresses(spark):
    private = {"10.0.0.1": True, "127.0.0.1": True, "172.16.0.1": True, "172.32.0.1": False, "192.168.3.4": True, "169.254.1.1": True, "224.0.0.5": True, "224.0.1.5": False, "8.8.8.8": False,
               "::1": True, "0:0:0:0:0:0:0:1": True, "fe80::1": True, "FC00::1": True, "fc::1": False, "2001:db8::1": False, "::ffff:192.168.0.1": True, "10.0.0.256": False, "junk": False, "": False}
    assert one(spark, private, E.is_private_ip) == private
    key = {"1.2.3.4": "0" * 20 + "ffff01020304", "2001:db8::1": "20010db8" + "0" * 23 + "1", "::": "0" * 32, "1:2:3:4:5:6:7:8": "00010002000300040005000600070008", "1:2": None, "1::2::3": None, "12345::": None, ":1:2:3:4:5:6:7": None}
    assert one(spark, key, E.ip_key) == key
    assert one(spark, {"169.254.1.1": 0, "FC": 0, "10.1": 0}, L.internal_ip) == {"169.254.1.1": False, "FC": False, "10.1": True}


def test_ranges(spark):
    r = spark.createDataFrame([("cidr", "10.1.2.3/22"), ("cidr", "2001:db8::/33"), ("ip", "1.2.3.4"), ("range", "1.1.1.1 - 1.1.1.9"), ("range", "2.2.2.2-1.1.1.1"), ("range", "1.1.1.1-::1"), ("ip", "x"), ("cidr", "1.1.1.1/99"), ("cidr", "0.0.0.0/0")], "rule_type string, value string")
    got = {x.value: (x.lo[-8:], x.hi[-8:]) for x in E.address_ranges(r).collect()}
    assert got == {"10.1.2.3/22": ("0a010000", "0a0103ff"), "2001:db8::/33": ("00000000", "ffffffff"), "1.2.3.4": ("01020304", "01020304"), "1.1.1.1 - 1.1.1.9": ("01010101", "01010109"), "0.0.0.0/0": ("00000000", "ffffffff")}


def test_hosts(spark):
    norm = {"WWW.Example.COM.": "www.example.com", "https://u:p@a.b:8443/x?y": "a.b", "*.c.org": "c.org", "": ""}
    assert one(spark, norm, E.normalize_host) == norm
    log = spark.createDataFrame([("s", "App.Example.com:443"), ("s", "-"), ("t", "app.example.com"), ("t", "1.2.3.4"), ("t", "localhost"), ("t", "a" * 300 + ".com")], "source_id string, host string")
    assert {(r.source_id, r.host) for r in E.discover_hosts(log, "source_id").collect()} == {("s", "app.example.com"), ("t", "app.example.com"), ("t", "1.2.3.4")}


def test_agents(spark):
    ua = {
        "Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) AppleWebKit/605 Version/16.0 Mobile/15E148 Safari/604.1": ("Safari", "iOS", "tablet"),
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605 Version/16.0 Safari/605": ("Safari", "macOS", "desktop"),
        "Mozilla/5.0 (Linux; Android 13; Pixel 7) Chrome/116.0 Mobile Safari/537.36": ("Chrome", "Android", "mobile"),
        "VirPulse/337 CFNetwork/3896.200.61 Darwin/27.2.0": ("VirPulse", "other", "apple"), "App/1 cfnetwork/1 darwin/1": ("App", "other", "apple"),
        "App/1 CFNetwork/3896.200.61": ("other", "other", "other"), "App/1 Darwin/27.2.0": ("other", "other", "other"),
        "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html) CFNetwork/1 Darwin/1": ("bot", "bot", "bot"),
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 Version/17.0 Mobile/15E148 Safari/604.1": ("Safari", "iOS", "mobile"),
        "curl/8.0.1": ("bot", "bot", "bot"), "": ("other", "other", "other"), None: ("other", "other", "other"),
    }
    got = E.classify_user_agents(spark.createDataFrame([(k,) for k in ua], "ua string")).collect()
    assert {r.ua: (r.browser, r.os, r.device) for r in got} == ua


def test_sanitize(spark):
    cut = {"abc": "abc", "ab\x00c": "abc", "aé": "aé", "aaé": "aa", "aa漢": "aa", "a𝄞": "a", "éé": "é"}
    got = one(spark, cut, lambda c: E.sanitize(c, 3))
    assert got == cut


def test_locations(spark):
    d = spark.createDataFrame([("广东·深圳·电信", "中国"), ("联通", "China"), ("内蒙古自治区 IDC", "中国"), ("", "中国"), ("Tokyo", "Japan")], "d string, g string")
    assert [r[0] for r in d.select(E.normalize_location(F.col("d"), F.col("g"))).collect()] == ["广东·深圳", "China", "内蒙古", "", "Tokyo"]
    p = {"China|0|Guangdong Province|Shenzhen City|Telecom": "China·Guangdong Province·Shenzhen City", "中国|0|北京|北京市|联通": "北京", "中国|0|0|0|0": "中国", "中国|广东省|深圳市|电信|0": "广东·深圳",
         "中国|0|新疆维吾尔自治区|乌鲁木齐市|电信": "新疆维吾尔·乌鲁木齐", "Japan|0|Osaka|Sakai|0": "Japan·Osaka·Sakai", "Mexico|0|0|Mexico City|0": "Mexico·Mexico City", "0|0|0|0|0": None}
    assert one(spark, p, lambda c: E.parse_region(c)[0]) == p
    cut = {"香港特别行政区": "香港", "新疆维吾尔自治区": "新疆维吾尔", "省": "省", "广东省": "广东", "深圳": "深圳", "": ""}
    assert one(spark, cut, E.strip_suffix) == cut
    city = {"香港特别行政区": "香港", "宁夏回族自治区": "宁夏回族", "大兴安岭地区": "大兴安岭", "朝阳区": "朝阳", "New - York": "newyork", "未知": "", "市": ""}
    assert one(spark, city, E.normalize_city) == city
    carrier = {"中国电信": True, "电信县": False, "Telecom": False, "": False, "长城宽带": True}
    assert one(spark, carrier, E.is_carrier) == carrier


def test_fingerprints(spark):
    lines = spark.createDataFrame([("f", "x")] * 5 + [("g", "x"), ("f", None), ("f", "")], "file string, line string")
    first = {(r.file, r.line, r.copy): r.fingerprint for r in E.line_fingerprints(lines, "s", "file").collect()}
    grown = lines.unionByName(lines.limit(3))
    again = {(r.file, r.line, r.copy): r.fingerprint for r in E.line_fingerprints(grown.repartition(3), "s", "file").collect()}
    assert len(first) == 8 and first.items() <= again.items()
    assert len({v for (f, x, c), v in again.items() if x}) == len([1 for (f, x, c) in again if x])


def test_named_ranges():
    now = datetime(2024, 3, 13, 15, 30)  # a Wednesday
    day = lambda m, d: datetime(2024, m, d)
    want = {"today": (day(3, 13), day(3, 14)), "yesterday": (day(3, 12), day(3, 13)), "week": (day(3, 11), day(3, 18)), "last7days": (day(3, 7), day(3, 14)), "month": (day(3, 1), day(4, 1)),
            "last30days": (day(2, 13), day(3, 14)), "2024-02-29": (day(2, 29), day(3, 1)), "nonsense": (day(3, 13), day(3, 14))}
    assert {k: T.named_range(k, now) for k in want} == want
    before = {"today": (day(3, 12), day(3, 13)), "week": (day(3, 4), day(3, 11)), "last7days": (day(2, 29), day(3, 7)), "month": (day(2, 1), day(3, 1)), "2024-03-01": (day(2, 29), day(3, 1))}
    assert {k: T.previous_range(k, now) for k in before} == before
    assert T.named_range("today", now, exact=False)[1] == day(3, 14) - timedelta(seconds=1)
    assert T.flexible_time("1700000000000") == T.flexible_time("1700000000") and T.flexible_time("2024-01-02 03:04") == datetime(2024, 1, 2, 3, 4) and T.flexible_time("x") is None
    assert T.intersect((10, 20), None, 15) == (10, 15) and T.intersect((10, 20), 12, None) == (12, 20)


def test_traffic(spark):
    sizes = {"0": "0.00 B", "1023": "1023.00 B", "4736": "4.62 KB", "1048576": "1.00 MB", "1610612736": "1.50 GB", str(5 * 1024**4): "5.00 TB"}
    assert one(spark, sizes, lambda c: L.traffic(c.cast("long"))) == sizes


def test_export(spark, tmp_path):
    from hitlake.sources.hits import load_hits

    log = load_hits(spark, "/root/testdata/sf0.001")
    L.export(log, str(tmp_path / "out"), lang="zh")
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert got.columns == list(L.HEADINGS.values()) and got.count() == log.count()
    E.export_geo_failures(spark.createDataFrame([(1, "1.1.1.1", "r", "s", "e", 0, 1700000000)], "id int, ip string, reason string, source string, error string, status_code int, created_at long"), str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).columns == ["website", "ip", "reason", "source", "error", "status_code", "created_at"]


def test_shared_folder_needed(spark, monkeypatch):
    from hitlake.streaming import jobs as J

    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        J.folder(Session())


@pytest.mark.parametrize("descending", [True, False])
def test_pages_behind_a_row(spark, descending):
    log = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(1, 30)], "id long, status_code int")
    want, got, after = [tuple(r) for r in L.page(log, "status_code", descending, 1, 100).collect()], [], None
    while rows := L.page_after(log, after, "status_code", descending, 7).collect():
        got += [tuple(r) for r in rows]
        after = (rows[-1].status_code, rows[-1].id)
    assert got == want
