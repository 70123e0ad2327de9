"""Meter readings on a grid of 5-minute slots: long tables, and one row per meter and day with a JSON series for each measure.

Channels are united and aggregated once, in place of a join for each channel, and
empty slots are never made unless a dense grid is asked for. All days go through
one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import SLOT_MINUTES, day_grid, on_grid, slot_label, slot_start
from meterlake.functions.keys import key_of
from meterlake.schemas import CHANNELS, MEASURE, MEASURES


def any_measure(measures: Sequence[str]) -> Column:
    return F.coalesce(*measures).isNotNull()


def united_channels(tables: Mapping[str, DataFrame], snap: bool = False) -> DataFrame:
    """All channels' rows with all measures (null where another channel's): ``data_id``, ``tv``, measures.

    Readings between slots are left out, or moved to their slot with ``snap``.
    """
    parts = []
    for name, measures in CHANNELS.items():
        if name in tables:
            t = tables[name]
            kept = t if snap else t.filter(on_grid(F.col("tv")))
            parts.append(kept.select("data_id", slot_start(F.col("tv")).alias("tv"), *(F.col(c).cast(MEASURE).alias(n) for c, n in measures)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    have = set(rows.columns)
    return rows.select("data_id", "tv", *(F.col(m) if m in have else F.lit(None).cast(MEASURE).alias(m) for m in MEASURES))


def with_meter(rows: DataFrame, catalogue: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Rows with their meter ``nio`` in place of ``data_id``; ``keys`` (one column) narrows the meters."""
    named = catalogue.select("data_id", key_of(catalogue, "meter_asset_no", "zeros_only_null").alias("nio")).filter("nio IS NOT NULL")
    if keys is not None:
        wanted = keys.select(key_of(keys, keys.columns[0], "digits").alias("nio")).filter("nio IS NOT NULL").distinct()
        named = named.join(wanted, "nio", "left_semi")
    return rows.join(named, "data_id")


def slot_values(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], ts: str = "tv", by_day: bool = False) -> DataFrame:
    """The highest value of each measure in each slot; slots without any go. Columns: keys, ``day``, ``hhmi``, measures.

    ``by_day`` deals rows by key and day first. A daily aggregate that follows then needs no exchange of its own; rows are not
    combined before the exchange, which gains little anyway where a slot's channels lie in different files.
    """
    slots = rows.withColumns({"day": F.col(ts).cast("date"), "hhmi": slot_label(F.col(ts))})
    slots = slots.repartition(*keys, "day") if by_day else slots
    return slots.groupBy(*keys, "day", "hhmi").agg(*(F.max(m).alias(m) for m in measures)).filter(any_measure(measures))


def long_table(rows: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per channel id and slot with any value: ``nio``, ``tv``, measures (several ids of one meter stay apart)."""
    slots = rows.groupBy("data_id", "nio", "tv").agg(*(F.max(m).alias(m) for m in measures))
    return slots.filter(any_measure(measures)).drop("data_id")


def long_table_by_joins(tables: Mapping[str, DataFrame], catalogue: DataFrame) -> DataFrame:
    """The long table as one join per channel on (``data_id``, ``tv``): for channels that repeat a slot, whose rows then combine."""
    frames = []
    for name, measures in CHANNELS.items():
        if name in tables:
            t = tables[name].filter(on_grid(F.col("tv")))
            frames.append(t.select("data_id", "tv", *(F.col(c).cast(MEASURE).alias(n) for c, n in measures)))
    slots = reduce(DataFrame.union, (f.select("data_id", "tv") for f in frames)).distinct()
    met = reduce(lambda a, b: a.join(b, ["data_id", "tv"], "left"), frames, slots)
    have = [m for m in MEASURES if m in met.columns]
    return with_meter(met, catalogue).filter(any_measure(have)).drop("data_id")


def series_json(slots: Column, measure: str) -> Column:
    """A measure of sorted slot structs as JSON by HH:mm, nulls left out."""
    said = F.transform(slots, lambda s: F.concat(F.lit('"'), s["hhmi"], F.lit('":'), s[measure].cast("string")))  # null where the measure is
    return F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}"))  # labels and decimals need no escapes


def daily_series(slots: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per key and day: a JSON series for each measure. ``slots`` as of ``slot_values``; a group has a day's slots at most."""
    day = slots.groupBy(*keys, "day").agg(F.sort_array(F.collect_list(F.struct("hhmi", *measures))).alias("slots"))
    return day.select(*keys, "day", *(series_json(F.col("slots"), m).alias(m) for m in measures))


def series_rows(daily: DataFrame, keys: Sequence[str], measures: Sequence[str], kind: str = "decimal(18,3)") -> DataFrame:
    """The inverse of ``daily_series``: keys, ``day``, ``measure``, ``hhmi``, ``value``."""
    parts = F.array(*(F.struct(F.lit(m).alias("measure"), F.from_json(m, f"map<string,{kind}>").alias("series")) for m in measures))
    long = daily.select(*keys, "day", F.explode(parts).alias("x"))
    return long.select(*keys, "day", "x.measure", F.explode("x.series").alias("hhmi", "value"))


def dense(slots: DataFrame, meters: DataFrame, keys: Sequence[str], day: Column, minutes: int = SLOT_MINUTES) -> DataFrame:
    """Every slot of ``day`` for every row of ``meters``, with values where there are any."""
    grid = day_grid(meters.select(*keys).distinct().withColumn("day", day.cast("date")), "day", minutes)
    labelled = grid.select(*keys, "day", slot_label(F.col("tv")).alias("hhmi"))
    return labelled.join(slots, [*keys, "day", "hhmi"], "left")


def daily_table(tables: Mapping[str, DataFrame], catalogue: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The wide daily table: ``nio``, ``day`` and 33 series."""
    slots = slot_values(with_meter(united_channels(tables), catalogue, keys), ["nio"], MEASURES, by_day=True)
    return daily_series(slots, ["nio"], MEASURES)


def time_grid(tables: Mapping[str, DataFrame], catalogue: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The long table of all channels: ``nio``, ``tv`` and 33 measures."""
    return long_table(with_meter(united_channels(tables), catalogue, keys))
