"""Helpers shared by the training-data operators: shared folder, row ids, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words: space and \x09-\x0D (what ``bytes.split()`` splits on).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temp folder where unset and the master is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="hitlake-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends at files."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/hitlake-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(at)
    if _scratch:
        _scratch[-1].append(at)
    return spark.read.schema(df.schema).parquet(at)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes inside are removed at the end: for jobs that have written their result by then."""
    _scratch.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for at in _scratch.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files, broadcasts and compiled code of plans that nothing refers to any more.

    It learns of them when the driver collects garbage, which Spark itself asks for every
    half an hour; a job of many short plans does between its stages.
    """
    spark._jvm.System.gc()


#: Bytes of a batch that goes to a Python worker.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers of ``BATCH`` bytes at most, unless the session asks for smaller ones.

    Spark fills them up to 10,000 rows; of whole texts that is a task's whole input, held by
    the executor (in buffers that double as they grow) and by the worker at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if now.isdigit() and int(now) > BATCH:
        spark.conf.set(name, str(BATCH))


def stable(df: DataFrame) -> DataFrame:
    """``df`` itself where it is a plain scan, whose rows come in the same order each time; else a written copy.

    After a shuffle the order of rows differs from run to run, so row ids would too.
    Spark sizes a scan's splits by the cores that live just then, unless
    ``spark.sql.files.minPartitionNum`` says how many to count on: it is set here, once
    for the session, so executors that come or go don't move rows to other splits.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", str(df.sparkSession.sparkContext.defaultParallelism))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for m in re.finditer(r"^[ :+-]*'?(\w+)", plan, re.M)}
    return df if nodes <= {"Project", "Filter", "Relation", "LogicalRDD"} else cut(df)


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Add a row id that is the same each time these files are read.

    It holds the split and the row's place in it, so repeated rows, null ids and
    repeated ids each keep a row of their own. Who adds ids to one frame twice
    calls ``stable`` on it first.
    """
    return stable(df).withColumn(name, F.monotonically_increasing_id())


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns: others, whatever their names, cannot clash with work columns."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def with_columns(df: DataFrame, more: str) -> StructType:
    """The frame's schema and more columns after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def among(df: DataFrame, wanted: DataFrame, key: str = "rid", most_bits: int = 1 << 26) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``wanted``: all that are, and few others.

    A bitmap of hashed keys, eight bits a key and ``most_bits`` at most (a million
    words to broadcast), spares the later exact join the shuffle of rows it would
    drop. With more keys than the bitmap holds it lets more rows through.
    """
    n = wanted.select(key).distinct().count()
    bits = min(most_bits, 1 << max(10, (8 * n).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    word, bit = F.shiftright(at, 6), F.expr("shiftleft(1L, cast(_at & 63 as int))")
    marks = wanted.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_word"), bit.alias("_bit"))
    marks = marks.groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    found = df.withColumn("_at", at).withColumn("_word", word).join(F.broadcast(marks), "_word")
    return found.where(F.col("_mask").bitwiseAND(bit) != 0).drop("_at", "_word", "_mask")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list by alternating large and small stars.

    Each round is two grouped minimums and two joins on the edge list; the edges
    only ever point at smaller nodes, and rounds stop when none changes
    (logarithmic in the longest path). Returns (node, root), root being the
    smallest node reachable; nodes without an edge do not appear.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="hitlake-code-")) / f"{top.name}-code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
