"""Lines of log files that grow, are rotated or come again under other names.

A file is known by what it holds: its head (the first line that is no comment) and a
checksum over its lines and their numbers. What was read is remembered as (source, head,
file_key, lines, checksums), a row per file read. A file whose first lines are those of a
known one is that file, grown or renamed: only the lines behind them are new, and they
keep its key. A file that begins otherwise, or has fewer lines than any known one that it
agrees with, is a new one and is read from its start. Files of one batch are compared among
themselves too.

A line's fingerprint is made of its file's key, its number and its text, so equal lines of one
file all count, and a file read again gives the same fingerprints. A file must end in a
whole line when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where what is remembered of one file ends: two 64-bit sums over (line number, line).
_SUMS = {"c1": ("nth", "line"), "c2": ("line", "nth")}


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` (line, file, block: where the split of the file begins) with nth, a line's number in its file from 0.

    Lines of a split follow each other in their task; splits are counted and summed up by
    file, so a file of any size is read by many tasks.
    """
    at = lines.withColumn("__at", F.monotonically_increasing_id())
    splits = at.groupBy("file", "block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy("file").orderBy("block")  # a row per split
    splits = splits.select("file", "block", "__first", (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    j = at.join(splits, ["file", "block"])
    return j.withColumn("nth", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__first", "__before")


def _sums() -> list[Column]:
    """Checksums of lines in place: unordered to add up, yet a line in another place changes them."""
    return [F.bit_xor(F.xxhash64(*cols)).alias(k) for k, cols in _SUMS.items()]


def states(lines: DataFrame) -> DataFrame:
    """A row per file of numbered lines: source_id, file, lines, head, c1, c2."""
    is_head = ~F.coalesce(F.col("line").startswith("#"), F.lit(False))
    first = F.min_by("line", F.when(is_head, F.col("nth")))
    return lines.groupBy("source_id", "file").agg(F.count("*").alias("lines"), F.sha1(F.coalesce(first, F.lit("")).cast("binary")).alias("head"), *_sums())


def new_lines(lines: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines not read before, with nth, file_key and fingerprint; rows to remember), of ``lines`` (line, file, block, source_id).

    ``seen`` are the rows remembered so far. A file's own key is a hash of what it holds and
    where it lay when it was first read.
    """
    there = numbered(lines.withColumn("source_id", F.coalesce("source_id", F.lit(""))))
    own = states(there).withColumn("own_key", F.sha1(F.concat_ws("\u0000", "source_id", "head", "file", "lines", "c1", "c2").cast("binary")))
    old = seen.select("source_id", "head", "lines", "c1", "c2", F.col("file_key").alias("key"), F.lit("").alias("by")).unionByName(
        own.select("source_id", "head", "lines", "c1", "c2", F.col("own_key").alias("key"), F.col("file").alias("by"))
    )
    o = old.select("source_id", "head", *[F.col(c).alias(f"o_{c}") for c in ("lines", "c1", "c2", "key", "by")])
    shorter = (F.col("o_lines") < F.col("lines")) | ((F.col("o_lines") == F.col("lines")) & (F.col("o_by") < F.col("file")))  # what was stored comes before equal files
    pairs = own.select("source_id", "head", "file", "lines").join(o, ["source_id", "head"]).where(shorter)
    begins = there.select("source_id", "file", "nth", "line").join(pairs.select("source_id", "file", "o_lines").distinct(), ["source_id", "file"]).where("nth < o_lines")
    sums = begins.groupBy("source_id", "file", "o_lines").agg(*_sums())
    same = pairs.join(sums, ["source_id", "file", "o_lines"]).where("c1 = o_c1 and c2 = o_c2")
    root = F.min_by("o_key", F.struct("o_lines", "o_by"))
    known = same.groupBy("source_id", "file").agg(F.max("o_lines").alias("known"), root.alias("root"))
    of = own.join(known, ["source_id", "file"], "left").select(
        "source_id", "head", "file", "lines", "c1", "c2", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("root", "own_key").alias("file_key")
    )
    fresh = there.join(of.select("source_id", "file", "known", "file_key"), ["source_id", "file"]).where("nth >= known").drop("known", "block")
    parts = [F.lit("offset:v1"), F.col("file_key"), F.col("nth").cast("string"), F.coalesce("line", F.lit(""))]
    remember = of.where("lines > known").select("source_id", "head", "file_key", "lines", "c1", "c2")
    return fresh.withColumn("fingerprint", F.sha1(F.concat_ws("\u0000", *parts).cast("binary"))), remember
