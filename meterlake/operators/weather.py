"""Hourly weather: from landed payloads to rows, to JSON by day, and onto readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.keys import prefix_all
from meterlake.operators.sampling import median_of
from meterlake.sources.files import write_dated

#: Variables of the weather service.
VARIABLES = ("temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "surface_pressure", "cloud_cover")


def payload_schema(variables: Sequence[str] = VARIABLES) -> str:
    series = ", ".join(f"{v}: array<double>" for v in variables)
    return f"day date, lat double, lon double, hourly struct<time: array<string>, {series}>"


#: Where a reader puts the text of a record that is not JSON of the schema.
CORRUPT = "_corrupt"


def read_payloads(spark: SparkSession, path: str, variables: Sequence[str] = VARIABLES, multiline: bool = False) -> DataFrame:
    """Landed payloads, one a line (or one a file), with the file they come from; a record that cannot be read keeps its text in ``_corrupt``."""
    reader = spark.read.schema(f"{payload_schema(variables)}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multiline)
    return reader.option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def judged(payloads: DataFrame) -> DataFrame:
    """``payloads`` with ``reason``: why one cannot be used, else null. A short series is no reason: it gives nulls."""
    times = F.col("hourly.time")
    odd = F.exists(times, lambda t: F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm")).isNull())
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "not a payload")
        .when(F.col("day").isNull(), "no day")
        .when(times.isNull() | (F.size(times) == 0), "no hours")
        .when(odd, "an hour that is none")
    )
    return payloads.withColumn("reason", reason)


def accepted(payloads: DataFrame) -> DataFrame:
    return judged(payloads).filter("reason IS NULL").drop(CORRUPT, "reason")


def quarantined(payloads: DataFrame) -> DataFrame:
    """``file``, ``reason`` and the ``record`` as text of the payloads that are not accepted."""
    bad = judged(payloads).filter("reason IS NOT NULL")
    return bad.select("file", "reason", F.coalesce(CORRUPT, F.to_json(F.struct("day", "lat", "lon", "hourly"))).alias("record"))


def land_payloads(spark: SparkSession, path: str, out: str, variables: Sequence[str] = VARIABLES, multiline: bool = False) -> None:
    """Hourly rows by day under ``out``/hourly (only the days that come are replaced), and what was refused under ``out``/quarantine."""
    payloads = read_payloads(spark, path, variables, multiline)
    write_dated(hourly_rows(accepted(payloads), variables), f"{out}/hourly", "day", ("hour",))
    quarantined(payloads).write.mode("append").parquet(f"{out}/quarantine")


def hourly_rows(payloads: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """``day``, ``hour`` and a column for each variable; a series that is too short gives nulls."""
    at = payloads.select("day", "hourly", F.posexplode("hourly.time").alias("i", "time"))
    hour = F.hour(F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")))
    return at.select("day", hour.cast("bigint").alias("hour"), *(F.get(F.col(f"hourly.{v}"), F.col("i")).alias(v) for v in variables))


def hours_json(values: Column) -> Column:
    """24 values by position as JSON with keys 00:00 to 23:00; missing ones stay as null."""
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.format_string("%02d:00", h))
    return F.to_json(F.map_from_arrays(hours, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.get(values, h))))


def daily_weather(rows: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """One row per day: a JSON column for each variable."""
    day = rows.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct(F.col("hour").cast("int"), F.struct(*variables)))).alias("by_hour"))
    slots = F.sequence(F.lit(0), F.lit(23))
    return day.select("day", *(hours_json(F.transform(slots, _value(v))).alias(v) for v in variables))


def _value(variable: str):
    return lambda h: F.try_element_at(F.col("by_hour"), h)[variable]


def for_meters(meters: DataFrame, daily: DataFrame, upper: bool = True) -> DataFrame:
    """Every meter with the weather of each day (few rows, checked by Spark before it broadcasts them)."""
    named = daily.toDF(*(c.upper() if upper and c != "day" else c for c in daily.columns))
    return meters.crossJoin(named)


def onto_slots(slots: DataFrame, weather: DataFrame, day: str = "day", hour: str = "hour", prefix: str = "weather_") -> DataFrame:
    """Slots with their hour's weather; both sides have ``day`` and ``hour``. Without these columns the slots come back unchanged."""
    if not {day, hour} <= set(slots.columns) or not {day, hour} <= set(weather.columns):
        return slots
    return slots.join(prefix_all(weather, [day, hour], prefix), [day, hour], "left")


def median_point(df: DataFrame, lat: str = "LAT", lon: str = "LONG", accuracy: int | None = None) -> DataFrame:
    """Median latitude and longitude, each without nulls; ``accuracy`` asks for an approximation."""
    points = df.select(F.col(lat).try_cast("double").alias("lat"), F.col(lon).try_cast("double").alias("lon"))
    if accuracy is not None:
        return points.agg(*(F.percentile_approx(c, 0.5, accuracy).alias(c) for c in ("lat", "lon")))
    return median_of(points, "lat", "lat").join(F.broadcast(median_of(points, "lon", "lon")), F.lit(True))  # one row each
