"""Versions of a folder of tables: a manifest names the parts that each table is made of.

A change writes its parts into folders of their own and then the next manifest, which
gets its name by a rename to a name that must be free. Readers take the newest manifest. A
change that dies at any step leaves the old state; what it wrote is named by no
manifest, and ``clean`` removes it. One change runs at a time: a second one finds the name
taken and fails. The file system must rename a file in one step.

A part may have lost rows since it was written: ``without`` lists (site, first day, last
day), null for any, that readers leave out, until the part is rewritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, at: str) -> list[str]:
    path, fs = _fs(spark, at)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def latest(spark: SparkSession, base: str) -> dict:
    """The newest manifest: version, tables (name -> parts) and batches (stream -> last batch loaded)."""
    found = max((x for x in _names(spark, f"{base}/manifest") if x.endswith(".json")), default=None)
    if found is None:
        return {"version": 0, "tables": {}, "batches": {}}
    path, fs = _fs(spark, f"{base}/manifest/{found}")
    data = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
    finally:
        data.close()


def new_part() -> str:
    """The name of what one change writes: its rows of a table lie in ``table/part=name``."""
    return f"p{uuid.uuid4().hex}"


def part(path: str, rows: int, merged: bool = False) -> dict:
    """An entry of a manifest. merged: no two rows of it have one key."""
    return {"path": path, "rows": rows, "merged": merged, "without": []}


def commit(spark: SparkSession, base: str, old: dict, tables: dict[str, list[dict]], batch: tuple[str, int] | None = None) -> None:
    """Switch to ``tables``: the change is there when the rename is done, and not before."""
    now = {"version": old["version"] + 1, "tables": tables, "batches": old["batches"] | (dict([batch]) if batch else {})}
    aside, fs = _fs(spark, f"{base}/manifest/_{uuid.uuid4().hex}")
    target, _ = _fs(spark, f"{base}/manifest/{now['version']:012d}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"version {now['version']} of {base} was written by another load")


def added(old: dict, new: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """The tables of a manifest with more parts."""
    return {k: old["tables"].get(k, []) + new.get(k, []) for k in {**old["tables"], **new}}


def hide(tables: dict[str, list[dict]], names: list[str], site: str | None, first: str | None = None, last: str | None = None) -> dict[str, list[dict]]:
    """``tables`` whose parts show no rows of a site (null: any) and days."""
    return {k: [{**p, "without": [*p["without"], [site, first, last]]} for p in v] if k in names else v for k, v in tables.items()}


def read(spark: SparkSession, base: str, parts: list[dict], schema: StructType) -> DataFrame:
    """What the parts show: one scan for all that hide the same."""
    out = None
    for hidden in {json.dumps(p["without"]): p["without"] for p in parts}.values():
        paths = [f"{base}/{p['path']}" for p in parts if p["without"] == hidden]
        df = spark.read.schema(schema).option("basePath", paths[0].rsplit("/", 1)[0]).parquet(*paths).select(schema.names)
        for site, first, last in hidden:
            gone = F.lit(True)
            if site is not None:
                gone = gone & F.col("site_id").eqNullSafe(F.lit(site))
            if first is not None:
                gone = gone & (F.col("day") >= F.lit(first).cast("date"))
            if last is not None:
                gone = gone & (F.col("day") <= F.lit(last).cast("date"))
            df = df.where(~gone)
        out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], schema) if out is None else out


def clean(spark: SparkSession, base: str) -> None:
    """Remove old manifests and parts that the newest does not name. Not while something reads an older version or loads."""
    now = latest(spark, base)
    used = {p["path"] for v in now["tables"].values() for p in v}
    for table in _names(spark, base):
        for name in _names(spark, f"{base}/{table}"):
            if name.startswith("part=") and f"{table}/{name}" not in used:
                drop(spark, f"{base}/{table}/{name}")
    for name in _names(spark, f"{base}/manifest"):
        if name != f"{now['version']:012d}.json":
            drop(spark, f"{base}/manifest/{name}")


def drop(spark: SparkSession, at: str) -> None:
    path, fs = _fs(spark, at)
    fs.delete(path, True)
