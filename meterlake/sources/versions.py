"""Tables by day that are published as versions.

Under a target lie ``data/run=<id>/<day>=<value>/``, written once and never changed, and ``versions/<number>.json``, one small file
for each version: which run holds each of its days. A version comes into being when its file gets its name, by one rename
in the target's file system (which has to be one whose renames are whole or not at all, as HDFS and local disks are; an object store needs a table format). A writer that
fails before that leaves readers on the version before; what it wrote is in no version, and ``sweep`` deletes it. Of two writers at the same
time the later rename fails.

A new version replaces the days that it brings. With ``covers`` it replaces all days of that range, so that days without rows go. All
other days are taken over without a copy.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date, datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.sources.files import inventory

_LOG = "version int, published_at string, day string, schema string, runs map<string, string>, rows bigint, bytes bigint, written int, dropped int"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, target: str) -> list[int]:
    return [int(n.split(".")[0]) for n in _names(spark, f"{target}/versions") if n.endswith(".json") and n[0].isdigit()]


def log(spark: SparkSession, target: str) -> DataFrame:
    """One row a version: ``version``, ``published_at``, rows and bytes written, days written, dropped and held, the version before."""
    found = spark.read.schema(_LOG).option("pathGlobFilter", "[0-9]*.json").json(f"{target}/versions")
    return found.select(
        "version", "published_at", "rows", "bytes", "written", "dropped", F.size("runs").alias("days"), F.nullif(F.col("version") - 1, F.lit(0)).alias("previous")
    )


def _entry(spark: SparkSession, target: str, version: int) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(f"{target}/versions/{version:08d}.json").first()[0])


def _switch(spark: SparkSession, target: str, entry: dict) -> None:
    """Bring a version into being: its file is written aside and then gets its name."""
    fs, aside = _files(spark, f"{target}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    _, named = _files(spark, f"{target}/versions/{entry['version']:08d}.json")
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # not over a version that is there
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, named, options)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        raise RuntimeError(f"version {entry['version']} of {target} was published meanwhile") from e


def publish(
    df: DataFrame,
    target: str,
    day: str = "report_day",
    order: Sequence[str] = (),
    covers: tuple[date | str, date | str] | None = None,
) -> int:
    """Write ``df`` and make it a version; returns the version's number. Its rows are counted by the write."""
    spark, run, counted = df.sparkSession, uuid.uuid4().hex, Observation()
    before = max(versions(spark, target), default=0)
    old = _entry(spark, target, before)["runs"] if before else {}
    path = f"{target}/data/run={run}"
    rows = df.repartitionByRange(day, *order).sortWithinPartitions(day, *order) if order else df.repartition(day)
    rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.partitionBy(day).parquet(path)
    days = [n.split("=", 1)[1] for n in _names(spark, path) if n.startswith(f"{day}=")]
    low, high = (str(x) for x in covers) if covers else ("", "")
    kept = {d: r for d, r in old.items() if d not in days and not (covers and low <= d <= high)}
    size = inventory(spark, path).agg(F.sum("size_bytes")).first()[0] or 0
    _switch(spark, target, {
        "version": before + 1, "published_at": datetime.now(timezone.utc).isoformat(), "day": day, "schema": df.schema.json(), "runs": kept | dict.fromkeys(days, run),
        "rows": counted.get["rows"], "bytes": size, "written": len(days), "dropped": len(old) - len(kept) - len(set(days) & set(old)),
    })
    return before + 1


def read(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest one; partitions are pruned as in any table by day."""
    there = versions(spark, target)
    if version is None and there:
        version = max(there)
    if version not in there:
        raise FileNotFoundError(f"no version {version or ''} under {target}".replace("  ", " "))
    entry = _entry(spark, target, version)
    schema, data = T.StructType.fromJson(json.loads(entry["schema"])), f"{target}/data"
    if not entry["runs"]:
        return spark.createDataFrame([], schema)
    paths = [f"{data}/run={r}/{entry['day']}={d}" for d, r in entry["runs"].items()]
    return spark.read.schema(schema).option("basePath", data).parquet(*paths).select(*schema.names)


def sweep(spark: SparkSession, target: str, keep: int = 10) -> int:
    """Delete versions but the last ``keep``, and runs that no version left refers to; returns the number of runs. Not while a writer is at work."""
    there = versions(spark, target)
    used = {r for v in there[-keep:] for r in _entry(spark, target, v)["runs"].values()}
    for v in there[:-keep]:
        fs, p = _files(spark, f"{target}/versions/{v:08d}.json")
        fs.delete(p, False)
    gone = [n for n in _names(spark, f"{target}/data") if n.startswith("run=") and n[4:] not in used]
    for n in gone:
        fs, p = _files(spark, f"{target}/data/{n}")
        fs.delete(p, True)
    return len(gone)
