"""Drained streams against their batch forms, over several batches with late rows."""

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from hitlake.plans import queries as plans
from hitlake.sources.hits import hits
from hitlake.streaming import jobs as J
from hitlake.streaming import state as K


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """70 files, the last hours first; one row in seven again 5, 10 and 15 minutes later."""
    at = tmp_path_factory.mktemp("events")
    t = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by([("ts", "descending")])
    few, k = t.take(list(range(0, len(t), 7))), t.schema.get_field_index("ts")
    for minutes in (5, 10, 15):
        later = pc.add(few["ts"], pa.scalar(minutes * 60, pa.int64()).cast(pa.duration("s")).cast(pa.duration("us")))
        t = pa.concat_tables([t, few.set_column(k, t.schema.field(k), later.cast(t.schema.field(k).type))])
    n = -(-len(t) // 69)
    for i in range(69):
        pq.write_table(t.slice(i * n, n), at / f"events-{i:02}.parquet")
    pq.write_table(t.slice(0, 0), at / "events.parquet")
    return str(at)


@pytest.mark.parametrize("name, form", [("stream_minutes", J.minute_windows), ("stream_sliding", J.sliding_activity), ("stream_sessions", J.session_windows)])
def test_stream_is_batch(spark, folder, name, form):
    from pyspark.sql import functions as F

    log = hits(spark.read.parquet(f"{folder}/event*.parquet")).withColumn("ts", F.timestamp_seconds("timestamp"))
    want = sorted(map(tuple, form(log).collect()))
    if name == "stream_minutes":  # the running stream's visitor count is approximate, the drained one's exact
        want = sorted(map(tuple, log.where("pageview_flag = 1").groupBy(F.expr("timestamp div 60 * 60")).agg(F.count("*"), F.count_distinct("ip")).collect()))
    assert want and sorted(map(tuple, plans.queries()[name](spark, folder).collect())) == want
    if name == "stream_sliding":
        assert {r[0] % 900 for r in want} == set(range(0, 900, 60))


def test_dedup(spark, folder):
    log = hits(spark.read.parquet(f"{folder}/event*.parquet")).select("url", "timestamp", "id").collect()
    want, last = [], {}
    for r in sorted(log, key=lambda r: (r.timestamp, r.id)):
        if r.timestamp - last.get(r.url, -600) >= 600:
            want.append((r.id, r.timestamp))
        last[r.url] = r.timestamp
    got = plans.queries()["stream_dedup"](spark, folder).select("id", "timestamp").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) < len(log)


def batches(spark, at, rows, schema, n):
    """A stream of n batches of rows, in their order."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(at))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def test_refreshed_time_to_live(spark, tmp_path):
    rows = [("a", 540 * i, i) for i in range(7)] + [("b", 0, 10), ("b", 600, 11), (None, 5, 12), (None, 6, 13)] + [("a", 540 * 6 + 600, 14)]
    schema = "key string, timestamp long, id long"
    got = J.run_once(K.suppress_duplicates(batches(spark, tmp_path / "t", rows, schema, 3), "key")).collect()
    assert sorted(r.id for r in got) == [0, 10, 11, 12, 13, 14]  # a key seen every 9 minutes for an hour passes once


def test_few_keys_are_remembered(spark, tmp_path):
    rows = [(f"k{i}", i, i) for i in range(40)] + [("k39", 41, 100), ("k0", 42, 101)]
    got = J.run_once(K.suppress_duplicates(batches(spark, tmp_path / "t", rows, "key string, timestamp long, id long", 2), "key", most_keys=10, buckets=1)).collect()
    assert {r.id for r in got} == {*range(40), 101}  # the key seen long ago is forgotten, the last one is not


@pytest.mark.parametrize("late", [None, "2 days"])
def test_sessions_ignore_late_hits(spark, tmp_path, late):
    import random

    from pyspark.sql import functions as F

    r, visitor = random.Random(4), lambda k: ("s", f"i{k}", "b", "o", "d")
    rows = [(*visitor(r.randint(0, 3)), 1, r.randint(0, 40000), i, f"/{i}") for i in range(300)] + [(*visitor(9), 0, 5, 1000, "/no")]
    schema = "site_id string, ip string, browser string, os string, device string, pageview_flag int, timestamp long, id long, url string"
    stream = batches(spark, tmp_path / "t", rows, schema, 4).withColumn("ts", F.timestamp_seconds("timestamp"))
    key = ["site_id", "ip", "browser", "os", "device", "start_ts"]
    got = {(x.ip, x.start_ts): (x.end_ts, x.entry_url, x.exit_url, x.page_count) for x in J.run_once(K.running_sessions(stream, late=late), "update", key).collect()}
    want, last, size = {}, {}, -(-len(rows) // 4)
    for i in range(0, len(rows), size):
        for x in sorted((x for x in rows[i : i + size] if x[5]), key=lambda x: (x[6], x[7])):
            now = last.get(x[1])
            if now and x[6] < now[1]:
                continue
            if now is None or x[6] - now[1] > 1800:
                now = last[x[1]] = [x[6], x[6], x[8], x[8], 1]
            else:
                now[1], now[3], now[4] = x[6], x[8], now[4] + 1
            want[x[1], now[0]] = tuple(now[1:])
    assert got == want and len(want) > 4
