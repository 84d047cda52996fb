"""Stored tables: loads that die at any step, null keys, odd site ids, batches against one load, files that grow."""

import pytest
from pyspark.sql import functions as F

from hitlake.operators import rollups as M
from hitlake.operators import sessions as S
from hitlake.operators import store as W
from hitlake.operators import versions as V
from hitlake.sources import files
from hitlake.sources.hits import load_hits
from hitlake.streaming import jobs as J

KINDS = ["hits", "agg_hourly", "agg_daily", "agg_hourly_ip", "agg_daily_ip", "first_seen", "sessions", "agg_session_daily", "agg_entry_daily"]


@pytest.fixture(scope="module")
def log(spark):
    g = load_hits(spark, "/root/testdata/sf0.001").where("id % 10 = 0").withColumn("fingerprint", F.sha1(F.col("request_id").cast("binary")))
    return g.withColumn("site_id", F.when(F.col("id") % 2 == 0, "a/b=%").otherwise("7"))


def state(spark, base, kinds=KINDS):
    t = W.load_tables(spark, base)
    return {k: sorted((tuple(sorted(r.asDict().items())) for r in t[k].collect()), key=repr) for k in kinds}


def of(log):
    """What the tables of these hits should be."""
    t = {**M.rebuild(log), "hits": log.select(*W.NAMES).withColumn("day", F.to_date(F.timestamp_seconds("timestamp")))}
    return {k: sorted((tuple(sorted(r.asDict().items())) for r in t[k].collect()), key=repr) for k in KINDS}


def test_batches_are_one_load(spark, log, tmp_path):
    base = str(tmp_path / "b")
    for i in (1, 0, 2):  # late hits, visitors and sessions over several batches
        W.write_batch(log.where(f"id div 10 % 3 = {i}"), base, ("s", i) if i == 2 else None)
    W.write_batch(log.where("id % 3 = 0"), base)  # all known
    want = of(log)
    assert state(spark, base) == want
    W.write_batch(log.limit(5).withColumn("fingerprint", F.lit(None).cast("string")), base, ("s", 2))  # a batch that was loaded
    assert state(spark, base) == want
    parts = V.latest(spark, base)["tables"]["agg_daily"]
    W.compact(spark, base, max(p["rows"] for p in parts) - 1)
    assert state(spark, base) == want
    W.compact(spark, base)
    assert state(spark, base) == want and len(V.latest(spark, base)["tables"]["agg_daily"]) == 1
    V.clean(spark, base)
    assert state(spark, base) == want
    W.rebuild(spark, base)
    assert state(spark, base) == want


def test_a_batch_writes_its_own_rows(spark, log, tmp_path):
    base = str(tmp_path / "b")
    W.write_batch(log, base)
    few = log.where("id % 100 = 0").withColumn("fingerprint", F.concat(F.lit("x"), "id"))
    W.write_batch(few, base)
    for name in ("fact_hits", "agg_hourly", "session_parts", "dim_url"):
        last = V.latest(spark, base)["tables"][name][-1]["path"]
        assert spark.read.parquet(f"{base}/{last}").count() <= few.count()


@pytest.mark.parametrize("what", ["write", "replace", "retention"])
def test_killed_at_every_step(spark, log, tmp_path, monkeypatch, what):
    base = str(tmp_path / "b")
    small = log.where("id % 20 = 0")
    W.write_batch(small.where("id % 40 = 0"), base)
    mid = 1705276800
    act = {
        "write": lambda: W.write_batch(small, base, ("s", 1)), "replace": lambda: W.replace_range(small.where("id % 60 = 0"), base, mid + 5000, mid + 500000, "a/b=%"),
        "retention": lambda: W.apply_retention(spark, base, mid + 5000),
    }[what]
    before, version, left, write, commit = state(spark, base, ["hits", "agg_daily"]), V.latest(spark, base), [0], W._write, V.commit

    class Killed(Exception):
        pass

    def dying(f):
        def run(*a):
            left[0] -= 1
            if left[0] < 0:
                raise Killed
            return f(*a)

        return run

    monkeypatch.setattr(W, "_write", dying(write))
    monkeypatch.setattr(V, "commit", dying(commit))
    for n in (0, 7, 12, 99):  # dies at the n-th write; a load has twelve before its commit
        left[0] = n
        try:
            act()
            break
        except Killed:
            assert V.latest(spark, base) == version
            if n in (0, 7):
                assert state(spark, base, ["hits", "agg_daily"]) == before
    monkeypatch.undo()
    assert V.latest(spark, base)["version"] == version["version"] + 1
    if what == "write":
        assert state(spark, base, ["hits"])["hits"] == of(small)["hits"]
        act()
        assert state(spark, base, ["hits"])["hits"] == of(small)["hits"]


def test_two_loads_at_once_are_noticed(spark, log, tmp_path):
    base = str(tmp_path / "b")
    old = V.latest(spark, base)
    V.commit(spark, base, old, {})
    with pytest.raises(RuntimeError):
        V.commit(spark, base, old, {})


def test_null_keys_and_odd_sites(spark, log, tmp_path):
    base = str(tmp_path / "b")
    few = log.where("id % 50 = 0")
    odd = few.limit(6).select(*W.NAMES)
    no_site = odd.withColumn("site_id", F.lit(None).cast("string"))
    no_time = odd.withColumn("timestamp", F.lit(None).cast("long"))
    null_city = few.withColumn("domestic", F.when(F.col("id") % 100 == 0, F.col("domestic"))).withColumn("global", F.when(F.col("id") % 100 != 0, F.col("domestic")))
    for _ in range(2):
        W.write_batch(null_city.select(*W.NAMES).unionByName(no_site).unionByName(no_time), base)
    assert state(spark, base) == of(null_city)
    assert W.load_tables(spark, base)["rejected_hits"].count() == 12
    W.replace_range(null_city.where("id % 100 = 0"), base, 0, 2**31, "a/b=%")
    assert state(spark, base) == of(null_city.where("site_id = '7' or id % 100 = 0"))
    W.clear_site(spark, base, "a/b=%")
    assert state(spark, base) == of(null_city.where("site_id = '7'"))
    W.compact(spark, base)
    assert state(spark, base) == of(null_city.where("site_id = '7'"))
    assert W.read_table(spark, base, "dim_url").count() == null_city.where("site_id = '7'").select("url").distinct().count()
    W.clear_site(spark, base)
    assert W.load_tables(spark, base)["hits"].count() == 0


def test_ids_tell_nulls(spark):
    hits = spark.createDataFrame([(None, "China"), ("China", None)], "domestic string, global string").selectExpr(
        "'i' as ip", "'u' as url", "'r' as referer", "'b' as browser", "'o' as os", "'d' as device", "domestic", "global"
    )
    assert M.decode_fact(M.encode_fact(hits), M.build_dims(hits)).count() == 2


def test_retention(spark, log, tmp_path):
    base, cut = str(tmp_path / "b"), 1705276800 + 40000
    for i in range(2):
        W.write_batch(log.where(f"id div 10 % 2 = {i}"), base)
    W.apply_retention(spark, base, cut)
    kept = log.where(F.col("timestamp") >= cut)
    want = of(kept)
    got = state(spark, base)
    s = S.sessionize(log).where(F.col("start_ts") >= cut)
    want["sessions"] = sorted((tuple(sorted(r.asDict().items())) for r in s.collect()), key=repr)
    for k in ("hits", "agg_hourly", "agg_daily", "agg_hourly_ip", "agg_daily_ip", "first_seen", "sessions"):
        assert got[k] == want[k], k
    W.compact(spark, base)
    assert state(spark, base)["sessions"] == want["sessions"] and state(spark, base)["hits"] == want["hits"]


def test_retention_across_midnight(spark, tmp_path):
    base, t = str(tmp_path / "b"), 1705276800
    first = load_hits(spark, "/root/testdata/sf0.001").limit(1)
    at = [t + 80000, t + 81000, t + 82500, t + 84000, t + 85500, t + 87000, t + 88500, t + 95000, t + 200000]
    log = first.drop("timestamp", "id", "pageview_flag").crossJoin(spark.createDataFrame(list(enumerate(at)), "id long, timestamp long")).withColumn("pageview_flag", F.lit(1)).withColumn("fingerprint", F.col("id").cast("string"))
    W.write_batch(log.where("id % 2 = 0"), base)
    W.write_batch(log.where("id % 2 = 1"), base)
    W.apply_retention(spark, base, t + 83000)
    assert [(r.start_ts, r.page_count) for r in W.load_tables(spark, base)["sessions"].orderBy("start_ts").collect()] == [(t + 95000, 1), (t + 200000, 1)]


LINE = '203.0.113.{} - - [24/Apr/2026:10:05:{:02d} +0000] "GET /{} HTTP/1.1" 200 1 "-" "M"'


def lines_of(n, start=0, tag="x"):
    return [LINE.format(i % 3, i % 60, tag) for i in range(start, n)]


def run(spark, tmp_path, name, text):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in text))
    base = str(tmp_path / "tables")
    J.ingest(J.stream_lines(spark, str(folder)), base, checkpoint=str(tmp_path / "state")).start().awaitTermination()
    return W.load_tables(spark, base)["hits"].count()


def test_grown_rotated_and_equal_lines(spark, tmp_path):
    one = lines_of(40) + [LINE.format(9, 9, "same")] * 3
    assert run(spark, tmp_path, "access.log", one) == 43  # three equal lines are three hits
    assert run(spark, tmp_path, "access.log.1", one) == 43  # rotated, unchanged
    assert run(spark, tmp_path, "access.log.2", one + [LINE.format(9, 9, "same")] + lines_of(5, tag="y")) == 49  # grown, an equal line among the new ones
    assert run(spark, tmp_path, "access.log.new", lines_of(20, start=3)) == 66  # another first line: another file
    assert run(spark, tmp_path, "access.log.other", lines_of(10) + lines_of(9, tag="z")) == 85  # begins alike, goes on otherwise: another file
    assert run(spark, tmp_path, "access.log.3", one + [LINE.format(9, 9, "same")] + lines_of(7, tag="y")) == 87


def test_comments_are_no_head(spark, tmp_path):
    top = ["#Software: x", "#Fields: y"]
    assert run(spark, tmp_path, "a", top + lines_of(5)) == 5
    assert run(spark, tmp_path, "b", top + lines_of(6, start=2)) == 9
    assert run(spark, tmp_path, "c", top + lines_of(8)) == 12


def test_files_of_one_batch(spark, tmp_path):
    spark_lines = []
    for name, text in (("a", lines_of(10)), ("b", lines_of(12)), ("c", lines_of(12)), ("d", lines_of(9, start=1))):
        (tmp_path / name).write_text("\n".join(text) + "\n")
        spark_lines.append(str(tmp_path / name))
    df = spark.read.option("maxPartitionBytes", 300).text(spark_lines).selectExpr("value as line", "_metadata.file_path as file", "_metadata.file_block_start as block", "'s' as source_id")
    none = spark.createDataFrame([], W.SEEN)
    fresh, seen = files.new_lines(df, none)
    assert {(k, v) for k, v in fresh.groupBy("file").count().collect()} == {(f"file:{tmp_path}/a", 10), (f"file:{tmp_path}/b", 2), (f"file:{tmp_path}/d", 8)}
    assert fresh.select("fingerprint").distinct().count() == 20 and seen.count() == 3
    again = files.new_lines(df, seen)
    assert again[0].count() == 0 and again[1].count() == 0


def test_numbers_of_lines_over_splits(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "f").write_text("\n".join(text) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = spark.read.text(str(tmp_path / "f")).selectExpr("value as line", "_metadata.file_path as file", "_metadata.file_block_start as block")
        assert df.rdd.getNumPartitions() > 5
        assert all(text[r.nth] == r.line for r in files.numbered(df).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
