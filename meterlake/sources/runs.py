"""Records of runs, snapshots of keys, and published versions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.calendar import day_literal, days
from meterlake.functions.keys import key_of
from meterlake.sources import versions
from meterlake.sources.files import exists, inventory, on_days, write_dated

STEP = "run_id string, name string, rows bigint, seconds double, output string, error string, finished_at string"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


@dataclass
class Run:
    """Steps of one run; rows are counted by the writes themselves."""

    spark: SparkSession
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    steps: list[tuple] = field(default_factory=list)

    def write(self, name: str, df: DataFrame, path: str, day: str = "report_day", order: tuple[str, ...] = ()) -> int:
        began, counted = datetime.now(timezone.utc), Observation()
        write_dated(df, path, day, order, counted=counted)
        rows = counted.get["rows"]
        self.record(name, rows, (datetime.now(timezone.utc) - began).total_seconds(), path)
        return rows

    def publish(self, name: str, df: DataFrame, target: str, day: str = "report_day", order: tuple[str, ...] = (), covers: tuple[date | str, date | str] | None = None) -> int:
        """A version of ``target``; returns its rows."""
        began = datetime.now(timezone.utc)
        number = versions.publish(df, target, day, order, covers)
        rows = versions.log(self.spark, target).filter(F.col("version") == number).first()["rows"]
        self.record(name, rows, (datetime.now(timezone.utc) - began).total_seconds(), f"{target} version {number}")
        return rows

    def record(self, name: str, rows: int, seconds: float, output: str = "") -> None:
        self.steps.append((self.run_id, name, rows, seconds, output, None, _now()))

    def error(self, name: str, message: str) -> None:
        self.steps.append((self.run_id, name, None, None, None, message, _now()))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.steps, STEP)

    def save(self, path: str) -> None:
        self.table().write.mode("append").parquet(path)


def key_snapshot(keys: DataFrame, day: date | str, created_at: str, column: str = "ucs") -> DataFrame:
    """A day's keys, each once, with their number on every row."""
    distinct = keys.select(F.col(keys.columns[0]).cast("string").alias(column)).filter(f"{column} IS NOT NULL").distinct()
    total = distinct.agg(F.count(F.lit(1)).alias("count"))  # reads the exchange of ``distinct`` a second time, not its input
    return distinct.crossJoin(F.broadcast(total)).select(column, "count", day_literal(day).alias("date"), F.lit(created_at).alias("created_at"))


def key_snapshots(rows: DataFrame, column: str, day: str, created_at: str) -> DataFrame:
    """The keys of each day, each once, with their number on every row; all days in one job."""
    keys = rows.select(F.col(column).cast("string").alias("ucs"), F.col(day).cast("date").alias("date")).filter("ucs IS NOT NULL AND date IS NOT NULL").distinct()
    counts = keys.groupBy("date").agg(F.count(F.lit(1)).alias("count"))  # a row a day
    return keys.join(counts, "date").select("ucs", "count", "date", F.lit(created_at).alias("created_at"))


def save_snapshots(rows: DataFrame, path: str, first: date | str, last: date | str, column: str = "ucs", day: str = "day") -> int:
    """One write for the snapshots of all days from ``first`` to ``last``; days without keys have none afterwards. Returns the version."""
    inside = rows.filter(F.col(day).cast("date").between(day_literal(first), day_literal(last)))
    keys = inside.select(key_of(inside, column).alias("ucs"), day)
    return versions.publish(key_snapshots(keys, "ucs", day, _now()), path, "date", covers=(first, last))


def save_snapshot(keys: DataFrame, path: str, day: date | str) -> int:
    return versions.publish(key_snapshot(keys, day, _now()), path, "date", covers=(day, day))


def load_snapshot(spark: SparkSession, path: str, day: date | str) -> DataFrame:
    found = versions.read(spark, path).filter(F.col("date") == day_literal(day))
    if found.isEmpty():
        raise FileNotFoundError(f"no snapshot of {day} under {path}")
    return found


def load_snapshots(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The snapshots of the days in ``wanted`` (one column); days without one are skipped. Only these days' partitions are read."""
    return on_days(versions.read(spark, path), wanted, "date")


def keep_version(df: DataFrame, target: str, day: str = "report_day", version: str | None = None) -> bool:
    """Copy what ``target`` has of the days in ``df`` to ``target``-versions/version=...; False if there is no such table yet."""
    spark = df.sparkSession
    if not exists(spark, target):
        return False
    old = spark.read.parquet(target)
    kept = old.join(df.select(day).distinct(), day, "left_semi").withColumn("version", F.lit(version or _now().replace(":", "-")))
    kept.write.mode("append").partitionBy("version", day).parquet(f"{target.rstrip('/')}-versions")
    return True


def publish(df: DataFrame, target: str, log: str, day: str = "report_day") -> int:
    """Replace the days in ``df`` at ``target`` in place, with a copy of what they were, and note rows and bytes in ``log``; returns the rows.

    For readers at the same time, and a switch that is whole or not at all, there is ``sources.versions``.
    """
    spark, counted = df.sparkSession, Observation()
    keep_version(df, target, day)
    write_dated(df, target, day, counted=counted)
    rows = counted.get["rows"]
    size = inventory(spark, target).agg(F.sum("size_bytes")).first()[0] or 0
    noted = spark.createDataFrame([(target, _now(), rows, size)], "target string, copied_at string, row_count bigint, file_size_bytes bigint")
    noted.write.mode("append").parquet(log)
    return rows


def days_back_lookup(spark: SparkSession, present: DataFrame, as_of: date | str, most: int, least: int = 1, day: str = "day") -> DataFrame:
    """``days_back``, ``day`` and whether there is data, for each day from ``least`` to ``most`` days back."""
    wanted = days(spark, F.date_sub(day_literal(as_of), most), F.date_sub(day_literal(as_of), least), "day")
    have = present.select(F.col(day).cast("date").alias("day")).distinct().withColumn("found", F.lit(True))
    met = wanted.join(have, "day", "left")
    return met.select(F.datediff(day_literal(as_of), "day").alias("days_back"), "day", F.coalesce("found", F.lit(False)).alias("found"))
