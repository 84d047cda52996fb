"""Line formats, one literal line each and more, against their fields."""

import pytest

from hitlake.sources import lines as P

#: format, line, fields
CASES = [
    ("nginx", '203.0.113.11 - - [24/Apr/2026:10:05:35 +0800] "POST /api/login HTTP/1.1" 302 64 "-" "Mozilla/5.0"',
     {"ip": "203.0.113.11", "timestamp": 1776996335, "method": "POST", "url": "/api/login", "status_code": 302, "bytes_sent": 64, "referer": "-", "ua": "Mozilla/5.0", "request_time_ms": 0}),
    ("tengine", '203.0.113.10 - bob [24/Apr/2026:10:05:35 +0800] "GET /a b%20c?x=1 HTTP/2.0" 200 - "" "" 0.134 33 0.133, 0.5 172.16.7.133:7004, 10.0.0.1:80 www.q.cn req-456',
     {"url": "/a b c?x=1", "bytes_sent": 0, "request_length": 33, "request_time_ms": 134, "upstream_response_time_ms": 500, "upstream_addr": "172.16.7.133:7004, 10.0.0.1:80",
      "host": "www.q.cn", "request_id": "req-456", "ua": "-"}),
    ("nginx", '203.0.113.10 - - [24/Apr/2026:10:05:35 +0800] "GET / HTTP/2.0" 200 1 "-" "B" 33 1.5s', {"request_length": 33, "request_time_ms": 1500, "host": ""}),
    ("nginx", '203.0.113.10 - - [24/Apr/2026:10:05:35 +0800] "GET / HTTP/2.0" 200 1 "-" "B" 33 7', {"request_length": 0, "request_time_ms": 0}),
    ("apache", '203.0.113.12 - - [24/Apr/2026:10:05:36 +0800] "GET /docs HTTP/1.1" 200 2048 "https://example.com/%E4%BD%A0" "Mozilla/5.0"',
     {"timestamp": 1776996336, "url": "/docs", "bytes_sent": 2048, "referer": "https://example.com/你"}),
    ("traefik", '203.0.113.17 - - [24/Apr/2026:10:05:40 +0800] "GET / HTTP/1.1" 200 612 "-" "Mozilla/5.0" 1 "app@docker" "http://10.0.0.5:8080" 12.5ms', {"request_time_ms": 12, "bytes_sent": 612}),
    ("envoy", '[2026-04-24T10:05:41.123Z] "GET /api HTTP/2" 200 - 7 256 15 14 "203.0.113.18" "curl/8.0.1" "req-abc" "api.example.com" "10.0.0.6:8080"',
     {"ip": "203.0.113.18", "timestamp": 1777025141, "request_length": 7, "bytes_sent": 256, "request_time_ms": 15000, "upstream_response_time_ms": 14000, "request_id": "req-abc",
      "host": "api.example.com", "upstream_addr": "10.0.0.6:8080"}),
    ("haproxy", 'Apr 24 10:05:39 lb haproxy[1234]: 203.0.113.16:53124 [24/Apr/2026:10:05:39.123] fe_http be_app/app1 0/0/1/12/13 200 1024 - - ---- 1/1/0/0/0 0/0 "GET /health HTTP/1.1"',
     {"ip": "203.0.113.16", "timestamp": 1777025139, "url": "/health", "bytes_sent": 1024}),
    ("haproxy", '203.0.113.16:53124 [24/Apr/2026:10:05:39.123] fe be/app1 0/0/1/12/-1 200 - - - ---- 1/1/0/0/0 0/0 {a b} - "GET /h HTTP/1.1"', {"url": "/h", "bytes_sent": 0}),
    ("ingress-nginx", '203.0.113.19 - - [24/Apr/2026:10:05:42 +0800] "GET /orders?id=42 HTTP/2.0" 200 512 "-" "curl/8.0.1" 128 0.245 [default-app-80] [] 10.0.0.7:8080, 10.0.0.8:80 0, 512 0.001, 0.200 502, 200 req-123',
     {"request_length": 128, "request_time_ms": 245, "upstream_response_time_ms": 200, "upstream_addr": "10.0.0.7:8080, 10.0.0.8:80", "request_id": "req-123"}),
    ("iis", "2026-04-24 10:05:38 10.0.0.10 GET /index.html a=1&b=2 443 - 203.0.113.15 Mozilla/5.0+(Windows+NT+10.0) https://example.com/ 200 0 0 36",
     {"ip": "203.0.113.15", "timestamp": 1777025138, "url": "/index.html?a=1&b=2", "status_code": 200, "request_time_ms": 0}),
    ("iis", "2026-04-24 10:05:38 10.0.0.10 GET /i - 443 - 203.0.113.15 M - 404 0 2 36", {"url": "/i", "status_code": 404}),
    ("npm", '[24/Apr/2026:10:05:37 +0800] - 502 200 - GET http app.example.com "/assets/app.js" [Client 203.0.113.14] [Length 4096] [Gzip -] [Sent-to 10.0.0.4] "Mozilla/5.0" "https://app.example.com/"',
     {"status_code": 502, "host": "app.example.com", "url": "/assets/app.js", "bytes_sent": 4096, "ip": "203.0.113.14", "upstream_addr": "10.0.0.4", "method": "GET"}),
    ("safeline", '192.168.1.242 - - [24/Apr/2026:10:05:43 +0800] "app.example.com" "GET /api/rules?=1 HTTP/2.0" 200 36 "-" "Mozilla/5.0 (Windows NT 10.0)" "-"',
     {"ip": "192.168.1.242", "timestamp": 1776996343, "host": "app.example.com", "url": "/api/rules?=1", "bytes_sent": 36, "ua": "Mozilla/5.0 (Windows NT 10.0)"}),
    ("leichi", '203.0.113.20 | - | 24/Apr/2026:10:05:43 +0800 | "app.example.com" | "POST /api/v1/tunnel HTTP/1.1" | 468 | 14862 | "-" | "Mozilla/5.0" "125.107.193.16"',
     {"ip": "203.0.113.20", "status_code": 468, "bytes_sent": 14862, "method": "POST"}),
    ("zoraxy", "[2026-04-24 10:05:44.123456] [router:host-http] [origin:app.example.com] [client: 203.0.113.21] [useragent: Mozilla/5.0 (X11)] GET /index.html 200",
     {"ip": "203.0.113.21", "timestamp": 1777025144, "host": "app.example.com", "ua": "Mozilla/5.0 (X11)", "bytes_sent": 0, "referer": ""}),
    ("zoraxy", "2026-04-24 10:05:44 [router:redirect] [origin:] [client: 198.51.100.20:53124] [useragent: curl/8.7.1] GET /socket 101", {"ip": "198.51.100.20", "status_code": 101}),
    ("caddy", '{"level":"info","ts":1777000000.5,"request":{"remote_ip":"203.0.113.13","method":"GET","uri":"/api/items","host":"api.example.com","headers":{"user-agent":["curl/8.0.1"],"REFERER":["https://example.com/"]}},"status":200,"size":128,"duration":0.034}',
     {"ip": "203.0.113.13", "timestamp": 1777000000, "url": "/api/items", "bytes_sent": 128, "request_time_ms": 34, "ua": "curl/8.0.1", "referer": "https://example.com/"}),
    ("caddy", '{"ts":"bad","time":"2026-04-24T10:00:00Z","request":{"client_ip":"[2001:db8::1]:99","method":"GET","uri":"/"},"status":"404","duration":"1m2.5s","duration_ns":7}',
     {"ip": "2001:db8::1", "timestamp": 1777024800, "status_code": 404, "request_time_ms": 62500}),
]
BAD = [
    ("nginx", "nonsense", "format"), ("nginx", None, "format"), ("zoraxy", "[2026-04-24 10:00:00.000000] [database] [system:info] Using bolt as the database backend", "format"),
    ("iis", "#Fields: date time s-ip", "format"), ("caddy", "{", "format"), ("caddy", '{"request":{"remote_ip":"1.1.1.1","method":"GET","uri":"/"},"status":200}', "time"),
    ("apache", '1.1.1.1 - - [24/Foo/2026:10:05:36 +0800] "GET / HTTP/1.1" 200 1 "-" "-"', "time"), ("apache", '1.1.1.1 - - [24/Apr/2026:10:05:36 +0800] "GET" 200 1 "-" "-"', "request"),
]


@pytest.mark.parametrize("fmt", sorted({c[0] for c in CASES}))
def test_formats(spark, fmt):
    own = [c for c in CASES if c[0] == fmt]
    df = spark.createDataFrame([(i, line) for i, (_, line, _) in enumerate(own)], "n int, line string")
    got = {r.n: r for r in P.parse(df, fmt).collect()}
    for i, (_, _, want) in enumerate(own):
        assert got[i].rejected is None
        assert {k: got[i][k] for k in want} == want


def test_rejects(spark):
    for fmt in {b[0] for b in BAD}:
        own = [b for b in BAD if b[0] == fmt]
        df = spark.createDataFrame([(i, line) for i, (_, line, _) in enumerate(own)], "n int, line string")
        hits, rejects = P.parse_lines(df, fmt)
        assert hits.count() == 0 and {r.n: r.rejected for r in rejects.collect()} == {i: b[2] for i, b in enumerate(own)}


def test_log_format(spark):
    f = P.log_format('$http_x_forwarded_for - $remote_addr [$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent" rt=$request_time "$upstream_response_time" $host')
    line = '9.9.9.9, 8.8.8.8 - 203.0.113.10 [24/Apr/2026:10:05:35 +0000] "GET /health HTTP/1.1" 200 12 "" "curl/8 (x)" rt=0.123 "0.1, 2" h.example'
    r = P.parse(spark.createDataFrame([(line,)], "line string"), f).first()
    assert (r.ip, r.url, r.request_time_ms, r.upstream_response_time_ms, r.host, r.ua) == ("203.0.113.10", "/health", 123, 2000, "h.example", "curl/8 (x)")
    json = P.log_format('{"@timestamp":"$time_iso8601","host":"$host","remote_addr":"$remote_addr","request":"$request","status":$status,"request_time":$request_time,"upstream":"$upstream_response_time"}')
    line = '{"@timestamp":"2026-04-24T10:05:35+08:00","host":"example.com","remote_addr":"203.0.113.10","request":"GET /index.html HTTP/1.1","status":200,"request_time":0.012,"upstream":""}'
    r = P.parse(spark.createDataFrame([(line,)], "line string"), json).first()
    assert (r.rejected, r.timestamp, r.url, r.request_time_ms) == (None, 1776996335, "/index.html", 12)
    with pytest.raises(ValueError):
        P.log_format("$remote_addr $status")
    with pytest.raises(ValueError):
        P.log_format("plain")


def test_custom_pattern(spark):
    f = P.Format(r'^(?P<ip>\S+) \[(?P<time>[^\]]+)\] "(?P<request_line>[^"]*)" (?P<status>\d{3}) (?P<bytes>\d+|-) (?P<duration_ms>\S+)$')
    r = P.parse(spark.createDataFrame([('1.1.1.1 [24/Apr/2026:10:05:35 +0000] "GET /x HTTP/1.1" 200 - 1500',)], "line string"), f).first()
    assert (r.ip, r.url, r.bytes_sent, r.request_time_ms) == ("1.1.1.1", "/x", 0, 1500)


def test_durations(spark):
    from pyspark.sql import functions as F

    cases = {"0.133": 133, "1.001": 1000, "1500000000": 1500, "0.1, 0.5,-": 500, "12ms": 12, "1h2m3s": 3723000, "5us": 0, "900000ns1s": 1000, "-": 0, "": 0, "x": 0, "-1": 0, "2S": 2000}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.ms for r in df.select("t", P.duration_ms(F.col("t")).alias("ms")).collect()} == cases
    assert df.where("t = '0.133'").select(P.duration_ms(F.lit("1500000000"), unit_ms=True)).first()[0] == 1500000000


def test_readers(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "logs" / "sub").mkdir(parents=True)
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\n")
    with gzip.open(tmp_path / "logs" / "sub" / "b.log.gz", "wt") as f:
        f.write("three\n")
    (tmp_path / "logs" / "c.txt").write_text("no\n")
    got = {r.line for r in P.read_lines(spark, str(tmp_path / "logs"), "*.log*").collect()}
    assert got == {"one", "two", "three"}
    index = {"items": [{"name": str(tmp_path / "logs" / "a.log"), "bytes": 8, "etag": "x"}, {"name": str(tmp_path / "logs" / "sub" / "b.log.gz"), "bytes": 9, "etag": "y"}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    at = str(tmp_path / "index.json")
    assert {(r.path.rsplit("/", 1)[1], r["size"]) for r in P.read_manifest(spark, at, {"name": "path", "bytes": "size"}).collect()} == {("a.log", 8), ("b.log.gz", 9)}
    assert {r.line for r in P.read_listed(spark, at, {"name": "path"}).collect()} == {"one", "two", "three"}
    pushed = spark.createDataFrame([("w", "s", ["x", "y"]), ("w", "t", [])], "website_id string, source_id string, lines array<string>")
    assert [(r.source_id, r.line) for r in P.read_line_batches(pushed).collect()] == [("s", "x"), ("s", "y")]
