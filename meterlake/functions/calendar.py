"""Days, slots of a day, retention. Nothing reads the clock: the day to count from is a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT_MINUTES = 5
RETENTION_MONTHS = 4


def day_literal(day: date | str) -> Column:
    return F.lit(str(day)).cast("date")


def report_day(as_of: date | str, days_back: int, least: int = 1) -> Column:
    """The day ``days_back`` days before ``as_of``."""
    if days_back < least:
        raise ValueError(f"days_back must be {least} or more")
    return F.date_sub(day_literal(as_of), days_back)


def earliest_day(as_of: date | str, months: int = RETENTION_MONTHS) -> Column:
    """The first day of the month ``months`` months before ``as_of``."""
    return F.trunc(F.add_months(day_literal(as_of), -months), "MM").cast("date")


def in_retention(day: Column, as_of: date | str, months: int = RETENTION_MONTHS) -> Column:
    return (day >= earliest_day(as_of, months)) & (day < day_literal(as_of))


def days(spark: SparkSession, first: Column, last: Column, name: str = "day") -> DataFrame:
    """All days from first to last, inclusive; none if last is before first."""
    one = spark.range(1).select(first.alias("a"), last.alias("b")).filter("a <= b")
    return one.select(F.explode(F.sequence("a", "b")).alias(name))


def slot_start(ts: Column, minutes: int = SLOT_MINUTES) -> Column:
    """The start of the slot that holds ``ts``; ``minutes`` divides an hour."""
    past = F.make_dt_interval(F.lit(0), F.lit(0), (F.minute(ts) % minutes).cast("int"), F.extract(F.lit("SECOND"), ts))
    return ts - past


def on_grid(ts: Column, minutes: int = SLOT_MINUTES) -> Column:
    """Is ``ts`` exactly a slot's start?"""
    return ts == slot_start(ts, minutes)


def slot_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def day_grid(df: DataFrame, day: str = "day", minutes: int = SLOT_MINUTES) -> DataFrame:
    """Each row once for each slot of its day, as ``tv``."""
    start = F.col(day).cast("timestamp_ntz")
    end = start + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(60 - minutes))
    return df.withColumn("tv", F.explode(F.sequence(start, end, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))))


def file_day(name: Column) -> Column:
    """The day in a file name that ends in _YYYYMMDD.csv or .parquet; null if there is none or it is no day."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"_(\d{8})\.(csv|parquet)$", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def reading_hour(text: Column) -> Column:
    """The hour of text like 31/12/2024 23:55:00; null if it is not a time."""
    return F.hour(F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss")))
