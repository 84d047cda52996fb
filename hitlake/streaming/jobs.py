"""Streaming jobs over lines and hits. Each is a transformation for a running stream.

``run_once`` drives one to the end. In append mode it leaves out what is open or late
at the end, so windows, sessions and duplicates of a finite table are drained by
``drain``: parts of each batch, merged when all are there, with the batch form's rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.operators import enrich as E
from hitlake.operators import store
from hitlake.operators.sessions import VISITOR
from hitlake.sources import files
from hitlake.sources import lines as P
from hitlake.sources.hits import COLUMNS, hits


def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    log = hits(spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/event*.parquet"))
    return log.withColumn("ts", F.timestamp_seconds("timestamp"))


def stream_lines(spark: SparkSession, folder: str, max_bytes: str | None = None) -> DataFrame:
    """New files of a folder, line by line (line, file, block); ``max_bytes`` bounds what a batch takes up ("32m").

    A file that has grown or was rotated comes to the folder under a new name; ``ingest``
    knows it by what it holds.
    """
    r = spark.readStream if max_bytes is None else spark.readStream.option("maxBytesPerTrigger", max_bytes)
    return r.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def ingest(stream: DataFrame, base: str, fmt="nginx", site: str = "site", checkpoint: str | None = None, name: str = "lines"):
    """Lines of a stream parsed, flagged and loaded batch by batch: a DataStreamWriter.

    Lines of files (line, file, block, and source_id where a site has several sources) are new
    where their file's known part ends, and all count; what was read of each file is stored
    with the hits in one step. Pushed lines (line, source_id) have no file: equal lines of a
    source are one hit. A batch that Spark repeats adds nothing. Hits are loaded however late.
    """
    source = stream if "source_id" in stream.columns else stream.withColumn("source_id", F.lit(""))

    def load(batch: DataFrame, batch_id: int) -> None:
        spark, mine = batch.sparkSession, store.V.new_part()
        if store.is_loaded(spark, base, (name, batch_id)):
            return
        if "file" in batch.columns:
            lines, seen = files.new_lines(batch, store.read_table(spark, base, "seen_files"))
            more = {"seen_files": seen}
        else:  # equal lines are one hit: one of them is parsed
            lines, more = E.stream_fingerprints(batch.select("line", "source_id").distinct()), None
        parsed = P.parse_lines(lines, fmt)[0]
        # agents are classified by a join of these rows with themselves, which would parse each line twice
        parsed = store.set_aside(parsed.select(*[c for c in parsed.columns if c in (*store.NAMES, "ua")]), base, mine)
        store.write_batch(as_hits(parsed, site), base, (name, batch_id), more)
        store.put_away(spark, base, mine)

    w = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint or f"{base}/_stream")
    return w.trigger(availableNow=True)


def as_hits(parsed: DataFrame, site: str) -> DataFrame:
    """Parsed lines as hits: site, id, user agent classified, location pending, page views flagged."""
    c = E.classify_user_agents(parsed, "ua")
    full = c.withColumn("site_id", F.lit(site)).withColumn("id", F.xxhash64("fingerprint")).withColumn("domestic", F.lit("pending")).withColumn("global", F.lit("pending"))
    return E.flag_pageviews(full).select(*[x.split()[0] for x in COLUMNS.split(", ")])


def dedup_lines(stream: DataFrame, key: str = "fingerprint", within: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def minute_windows(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    w = stream.where("pageview_flag = 1").withWatermark("ts", late).groupBy(F.window("ts", "1 minute"))
    return w.agg(F.count("*").alias("pv"), F.approx_count_distinct("ip").alias("uv")).select(F.unix_timestamp("window.start").alias("bucket"), "pv", "uv")


def sliding_activity(stream: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    w = stream.where("pageview_flag = 1").withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes", "1 minute"))
    return w.agg(F.count("*").alias("pv")).select(F.unix_timestamp("window.start").alias("bucket"), "pv")


def session_windows(stream: DataFrame, gap: int = 1800, late: str = "1 hour") -> DataFrame:
    w = stream.where("pageview_flag = 1").withWatermark("ts", late).groupBy(*VISITOR, F.session_window("ts", f"{gap} seconds"))
    return w.agg(F.count("*").alias("page_count")).select("site_id", "ip", F.unix_timestamp("session_window.start").alias("start_ts"), "page_count")


def first_seen(stream: DataFrame) -> DataFrame:
    return stream.where("pageview_flag = 1").groupBy("site_id", "ip").agg(F.min("timestamp").alias("first_ts"))


def minute_parts(batch: DataFrame) -> DataFrame:
    return batch.where("pageview_flag = 1").groupBy(F.window("ts", "1 minute").alias("w"), "ip").agg(F.count("*").alias("pv"))


def merged_minutes(parts: DataFrame) -> DataFrame:
    return parts.groupBy(F.unix_timestamp("w.start").alias("bucket")).agg(F.sum("pv").alias("pv"), F.count_distinct("ip").alias("uv"))


def merged_sliding(parts: DataFrame, minutes: int = 30) -> DataFrame:
    """Sliding windows from ``minute_parts``: a slide of one minute cuts no minute."""
    own = parts.groupBy(F.col("w.start").alias("ts")).agg(F.sum("pv").alias("n"))
    w = own.groupBy(F.window("ts", f"{minutes} minutes", "1 minute"))
    return w.agg(F.sum("n").alias("pv")).select(F.unix_timestamp("window.start").alias("bucket"), "pv")


def _rejoined() -> Column:
    """Windows over parts (``w``: a session window of one batch): parts that touch are one session."""
    return F.session_window("start", F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((unix_micros(w.end) - unix_micros(w.start)) / 1e6 as decimal(18, 6)))"))


def session_parts(batch: DataFrame, gap: int = 1800) -> DataFrame:
    w = F.session_window("ts", f"{gap} seconds").alias("w")
    return batch.where("pageview_flag = 1").groupBy(*VISITOR, w).agg(F.count("*").alias("page_count"))


def merged_sessions(parts: DataFrame) -> DataFrame:
    w = parts.withColumn("start", F.col("w.start")).groupBy(*VISITOR, _rejoined())
    return w.agg(F.sum("page_count").alias("page_count")).select("site_id", "ip", F.unix_timestamp("session_window.start").alias("start_ts"), "page_count")


def dedup_parts(batch: DataFrame, key: str = "fingerprint", within: int = 600) -> DataFrame:
    """Rows (id, ts) of a key less than ``within`` seconds after the one before are one; a row without ts stays."""
    b = batch.select(F.col(key).alias("key"), "id", "ts")
    w = F.session_window("ts", f"{within * 1_000_000 - 1} microseconds").alias("w")
    seen = b.groupBy("key", w).agg(F.min(F.struct("ts", "id")).alias("first"))
    return seen.unionByName(b.where("ts is null").select("key", F.struct("ts", "id").alias("first")), allowMissingColumns=True)


def merged_dedup(parts: DataFrame) -> DataFrame:
    w = parts.withColumn("start", F.col("w.start")).groupBy("key", _rejoined()).agg(F.min("first").alias("first"))
    return w.select("first").unionByName(parts.where("w is null").select("first")).select("first.id", "first.ts")


def folder(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="hitlake-stream-")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, parts: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All of what is there, in any number of batches and any order of rows: parts a batch, then merged."""
    spark = stream.sparkSession
    at = folder(spark)
    none = parts(spark.createDataFrame([], stream.schema))
    none.write.parquet(f"{at}/out/none")
    w = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    w.foreachBatch(lambda df, n: parts(df).write.mode("overwrite").parquet(f"{at}/out/{n}")).start().awaitTermination()
    return merged(spark.read.schema(none.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out"))


def run_once(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Drain what is there into a Parquet table in the shared folder and read it.

    ``update`` keeps each batch's rows under the batch's number and gives, for each ``key``,
    those of its last batch; ``complete`` gives the last batch.
    """
    spark = stream.sparkSession
    at = folder(spark)
    w = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        w.format("parquet").option("path", f"{at}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    spark.createDataFrame([], stream.schema).withColumn("__batch", F.lit(-1).cast("long")).write.parquet(f"{at}/out/none")
    w.foreachBatch(lambda df, n: df.withColumn("__batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{at}/out/{n}")).start().awaitTermination()
    held = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")
    if mode == "complete":
        last = held.agg(F.max("__batch").alias("__last"))
        return held.join(F.broadcast(last), held["__batch"] == last["__last"]).select(*stream.columns)  # one row
    row = F.struct(*[F.col(f"`{c}`") for c in stream.columns])
    return held.groupBy(*key).agg(F.max_by(row, "__batch").alias("__row")).select("__row.*")
