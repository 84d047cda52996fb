"""The stored tables: facts, dimensions and what is derived from them, in one folder.

Facts refer to five dimensions by hashes of their natural keys. A load writes parts with its
own rows alone: new facts, their dimension rows, and what they add to the derived
tables (counts, visitor sets, first seen, parts of sessions). ``load_tables`` merges
parts on reading: counts add, sets unite, first seen takes the least, parts of sessions
that touch are one session, whatever batch and order their hits came in. ``compact`` merges
parts on disk. So a one-minute batch costs what it holds, not the days it touches.

Parts become visible together when the next manifest is written (``versions``), so a load
is there whole or not at all. The manifest also keeps the last batch of each stream: a batch
that Spark repeats adds nothing, with or without fingerprints.

Hits without a site or a time can be in no table by site and day; they are kept in
``rejected_hits``, and come from there but once for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hitlake.sources.hits import COLUMNS

from . import rollups as M
from . import sessions as S
from . import versions as V
from .basics import GAP, day, pv
from .enrich import sanitize_hits

#: Tables stored by day: what hits add to them.
BY_DAY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "agg_hourly": M.agg_hourly, "agg_daily": M.agg_daily, "agg_hourly_ip": M.agg_hourly_ip, "agg_daily_ip": M.agg_daily_ip,
    "first_seen": lambda log: log.where(pv()).groupBy("site_id", day().alias("day"), "ip").agg(F.min("timestamp").alias("first_ts")),
    "session_parts": lambda log: S.session_parts(log, chunk=day()).withColumnRenamed("chunk", "day"),
}
#: Tables that lose rows with their hits.
_OF_HITS = ["fact_hits", *BY_DAY]
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: What a load remembers of the files it read (see ``hitlake.sources.files``).
SEEN = "source_id string, head string, file_key string, lines long, c1 long, c2 long"


def _merged(name: str, df: DataFrame) -> DataFrame:
    """Rows of several parts as one table's."""
    if name in ("agg_hourly", "agg_daily"):
        keys = [c for c in ("site_id", "bucket", "day") if c in df.columns]
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in keys]).select(df.columns)
    if name == "first_seen":
        return df.groupBy("site_id", "day", "ip").agg(F.min("first_ts").alias("first_ts")).select(df.columns)
    if name in ("agg_hourly_ip", "agg_daily_ip"):
        return df.distinct()
    return df.dropDuplicates([f"{name[4:]}_id"]) if name.startswith("dim_") else df


def _by_day(name: str, log: DataFrame) -> DataFrame:
    own = BY_DAY[name](log)
    return own if "day" in own.columns else own.withColumn("day", F.to_date(F.timestamp_seconds("bucket")))


def _schema(spark: SparkSession, name: str) -> StructType:
    none = spark.createDataFrame([], COLUMNS)
    if name == "seen_files":
        return StructType.fromDDL(SEEN)
    if name == "rejected_hits":
        return none.schema
    if name == "fact_hits":
        return M.encode_fact(none.withColumn("day", day())).schema
    return M.build_dims(none)[name[4:]].schema if name.startswith("dim_") else _by_day(name, none).schema


def read_table(spark: SparkSession, base: str, name: str, now: dict | None = None) -> DataFrame:
    """A stored table, parts merged."""
    parts = (now or V.latest(spark, base))["tables"].get(name, [])
    df = V.read(spark, base, parts, _schema(spark, name))
    return df if len(parts) < 2 and all(p["merged"] for p in parts) else _merged(name, df)


def hits_of(spark: SparkSession, base: str, now: dict | None = None) -> DataFrame:
    """The stored hits, dimensions looked up, with their day."""
    now = now or V.latest(spark, base)
    return M.decode_fact(read_table(spark, base, "fact_hits", now), {k: read_table(spark, base, f"dim_{k}", now) for k in M.DIMENSIONS})


def _write(df: DataFrame, base: str, path: str) -> None:
    """One part of a table: a folder a day where rows have a day, sorted by site inside."""
    if "day" in df.columns:
        df.hint("rebalance", "day", "site_id").sortWithinPartitions("day", "site_id").write.partitionBy("day").parquet(f"{base}/{path}")
    else:
        df.write.parquet(f"{base}/{path}")


def _write_parts(tables: dict[str, DataFrame], base: str, mine: str, rows: int, merged: bool = False) -> dict[str, list[dict]]:
    if tables:
        with ThreadPoolExecutor(len(tables)) as pool:  # small jobs that do not wait for each other
            list(pool.map(lambda name: _write(tables[name], base, f"{name}/part={mine}"), tables))
    return {name: [V.part(f"{name}/part={mine}", rows, merged)] for name in tables}


def _parts_of(new: DataFrame, base: str, mine: str) -> dict[str, list[dict]]:
    """Parts that these hits (with day) add to all tables; none where there are no hits."""
    new = new.persist(StorageLevel.MEMORY_AND_DISK)  # a lost block is made again from what was staged
    try:
        rows = new.count()
        if not rows:
            return {}
        log = new.drop("day")
        tables = {f"dim_{k}": d for k, d in M.build_dims(new).items()} | {"fact_hits": M.encode_fact(new)} | {name: _by_day(name, log) for name in BY_DAY}
        return _write_parts(tables, base, mine, rows)
    finally:
        new.unpersist()


def set_aside(rows: DataFrame, base: str, mine: str) -> DataFrame:
    """``rows`` written beside the tables and read back: what follows reads them several times. ``put_away`` removes them."""
    rows.write.parquet(f"{base}/staged/part={mine}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{base}/staged/part={mine}")


def put_away(spark: SparkSession, base: str, mine: str) -> None:
    V.drop(spark, f"{base}/staged/part={mine}")


def _staged(log: DataFrame, base: str, mine: str) -> DataFrame:
    """Sanitised hits with their day, set aside."""
    return set_aside(sanitize_hits(log.select(*NAMES)).withColumn("day", day()), base, mine)


def is_loaded(spark: SparkSession, base: str, batch: tuple[str, int]) -> bool:
    """Whether a load of this batch (stream, number) was committed."""
    return V.latest(spark, base)["batches"].get(batch[0], -1) >= batch[1]


def write_batch(log: DataFrame, base: str, batch: tuple[str, int] | None = None, more: dict[str, DataFrame] | None = None) -> None:
    """Load hits in one step.

    A hit whose (timestamp, fingerprint) its site has stored already is left out; hits without
    fingerprint always count. ``batch`` (stream, number) makes a load that was committed a
    no-op when it is repeated; ``more`` are rows for other tables of the same commit.
    """
    spark = log.sparkSession
    old = V.latest(spark, base)
    if batch and old["batches"].get(batch[0], -1) >= batch[1]:
        return
    mine = V.new_part()
    staged = _staged(log, base, mine)
    good = F.col("site_id").isNotNull() & F.col("timestamp").isNotNull()
    hits, bad = staged.where(good), staged.where(~good).select(*NAMES)
    at = hits.agg(F.min("timestamp"), F.max("timestamp"), F.min("day"), F.max("day")).first()
    new = {}
    if at[0] is not None:
        span = F.col("timestamp").between(at[0], at[1]) & F.col("day").between(F.lit(at[2]), F.lit(at[3]))
        new = _parts_of(M.dedup_new(hits, read_table(spark, base, "fact_hits", old).where(span)), base, mine)
    known = read_table(spark, base, "rejected_hits", old)
    key = ["site_id", "timestamp", "fingerprint"]
    keyed = bad.where("fingerprint is not null").dropDuplicates(key).alias("b")
    fresh = keyed.join(known.select(*key).alias("k"), F.col("b.site_id").eqNullSafe(F.col("k.site_id")) & F.col("b.timestamp").eqNullSafe(F.col("k.timestamp")) & (F.col("b.fingerprint") == F.col("k.fingerprint")), "left_anti")
    bad = fresh.unionByName(bad.where("fingerprint is null"))
    if not bad.isEmpty():
        more = {"rejected_hits": bad, **(more or {})}
    new |= _write_parts(more or {}, base, mine, 0)
    V.commit(spark, base, old, V.added(old, new), batch)
    put_away(spark, base, mine)


def rebuild(spark: SparkSession, base: str) -> None:
    """Everything derived, anew from the stored hits: in place of all parts at once."""
    old, mine = V.latest(spark, base), V.new_part()
    log = hits_of(spark, base, old).drop("day")
    new = _write_parts({name: _by_day(name, log) for name in BY_DAY}, base, mine, sum(p["rows"] for p in old["tables"].get("fact_hits", [])), merged=True)
    V.commit(spark, base, old, old["tables"] | new)


def replace_range(log: DataFrame, base: str, start: int, end: int, site: str) -> None:
    """A site's stored hits of [start, end) are replaced by those of ``log`` in one step; only the days at its ends keep hits and are written again."""
    spark, t = log.sparkSession, F.col("timestamp")
    old, mine = V.latest(spark, base), V.new_part()
    first, last = str(_day_of(spark, start)), str(_day_of(spark, end - 1))
    days = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    kept = hits_of(spark, base, old).where((F.col("site_id") == site) & days & ((t < start) | (t >= end)))
    new = _staged(log.where((t >= start) & (t < end) & (F.col("site_id") == site)), base, mine)
    all_ = kept.select(new.columns).unionByName(M.dedup_new(new, new.limit(0)))
    parts = _parts_of(all_, base, mine)
    V.commit(spark, base, old, V.added({"tables": V.hide(old["tables"], _OF_HITS, site, first, last)}, parts))
    put_away(spark, base, mine)


def _day_of(spark: SparkSession, at: int) -> date:
    """The day of an epoch second in the session's time zone."""
    return spark.range(1).select(F.to_date(F.timestamp_seconds(F.lit(at)))).first()[0]


def apply_retention(spark: SparkSession, base: str, cutoff: int) -> None:
    """Hits before ``cutoff`` go, with their buckets, visitors and sessions that started before, in one step.

    Whole days are hidden, not rewritten; the day of the cutoff is derived anew from the
    hits it keeps. A session that goes on across the cutoff goes whole, as one that started before.
    """
    old, mine = V.latest(spark, base), V.new_part()
    edge = _day_of(spark, cutoff)
    boundary = hits_of(spark, base, old).where((F.col("day") == F.lit(edge)) & (F.col("timestamp") >= cutoff))
    near = read_table(spark, base, "session_parts", old).where(F.col("day") >= F.date_sub(F.lit(edge), 1 + GAP // 86400))
    across = S.merge_parts(near.drop("day")).where((F.col("start_ts") < cutoff) & (F.col("end_ts") >= cutoff)).select(*S.VISITOR, F.col("end_ts").alias("gone"))
    far = across.agg(F.max("gone")).first()[0]
    last = edge if far is None else _day_of(spark, far)
    parts = {k: v for k, v in _parts_of(boundary, base, mine).items() if k in _OF_HITS}  # its dimension rows are known
    same = F.lit(True)
    for c in S.VISITOR:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"a.{c}"))
    held = near.where(F.col("day").between(F.lit(edge), F.lit(last)) & (F.col("start_ts") >= cutoff)).alias("p").join(across.alias("a"), same & (F.col("start_ts") <= F.col("gone")), "left_anti")
    parts |= _write_parts({"session_parts": held.select(near.columns)}, base, V.new_part(), 0)
    tables = V.hide(old["tables"], _OF_HITS, None, None, str(edge))
    if last != edge:
        tables = V.hide(tables, ["session_parts"], None, str(edge), str(last))
    V.commit(spark, base, old, V.added({"tables": tables}, parts))


def clear_site(spark: SparkSession, base: str, site: str | None = None) -> None:
    """A site's hits and what is derived from them go, whatever its id; or all tables."""
    old = V.latest(spark, base)
    V.commit(spark, base, old, {} if site is None else V.hide(old["tables"], [*_OF_HITS, "rejected_hits"], site))


def compact(spark: SparkSession, base: str, most_rows: int | None = None) -> None:
    """Parts of loads of at most ``most_rows`` hits (null: all) become one part of each table; hidden rows go, and so do dimension rows that no hit refers to where all parts are merged."""
    old, mine = V.latest(spark, base), V.new_part()
    small = lambda p: most_rows is None or p["rows"] <= most_rows
    tables = dict(old["tables"])
    for name, parts in old["tables"].items():
        few = [p for p in parts if small(p)]
        if len(few) < 2 and not any(p["without"] for p in few):
            continue
        df = _merged(name, V.read(spark, base, few, _schema(spark, name)))
        if name.startswith("dim_") and most_rows is None:
            key = f"{name[4:]}_id"
            df = M.prune_dims(df, key, [(read_table(spark, base, "fact_hits", old), key)])
        rest = [p for p in parts if not small(p)]
        tables[name] = rest + _write_parts({name: df}, base, mine, sum(p["rows"] for p in few), merged=True)[name]
    V.commit(spark, base, old, tables)


def load_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The stored tables of one version: hits, roll-ups, visitor sets, first seen, sessions and what is counted from them, rejected hits."""
    now = V.latest(spark, base)
    read = lambda name: read_table(spark, base, name, now)
    s = S.merge_parts(read("session_parts").drop("day"))
    out = {"hits": hits_of(spark, base, now), "sessions": s, "session_state": S.session_state(s), "agg_session_daily": S.agg_session_daily(s), "agg_entry_daily": S.agg_entry_daily(s)}
    out |= {name: read(name) for name in ("agg_daily", "agg_daily_ip", "rejected_hits")} | {name: read(name).drop("day") for name in ("agg_hourly", "agg_hourly_ip")}
    out["first_seen"] = read("first_seen").groupBy("site_id", "ip").agg(F.min("first_ts").alias("first_ts"))
    return out | {f"dim_{k}": read(f"dim_{k}") for k in M.DIMENSIONS}


def batch_sink(base: str, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: loads each batch of the named stream once. A stream that starts anew, without its checkpoint, needs a new name."""
    return lambda batch, batch_id: write_batch(batch, base, (stream, batch_id))
