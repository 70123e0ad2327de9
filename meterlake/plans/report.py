"""The daily report, exports and periods."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import day_literal, days, in_retention
from meterlake.functions.keys import collision_names, distinct_keys, is_truthy, keep_first, key_of, upper_names
from meterlake.operators.quality import unique_rows, verify_output
from meterlake.operators.readings import daily_table
from meterlake.operators.registry import registry
from meterlake.operators.sampling import spread_sample
from meterlake.operators.topology import join_colliding, join_prefixed, topology
from meterlake.sources import versions as V
from meterlake.sources.runs import Run, save_snapshots
from meterlake.sources.shared import materialize


def report(base: DataFrame, daily: DataFrame, report_days: DataFrame, key: str = "NIO") -> DataFrame:
    """Every meter on every report day, with its series if there are any: left join, ``REPORT_DAY``, ``HAS_MDM_DATA``."""
    wanted = base.crossJoin(report_days.select(F.col(report_days.columns[0]).cast("date").alias("REPORT_DAY")))
    right = daily.withColumnRenamed("day", "DIA")
    right = right.withColumnRenamed(next(c for c in right.columns if c.upper() == key.upper()), "__key")
    met = (F.col(key) == F.col("__key")) & (F.col("REPORT_DAY") == F.col("DIA"))
    return wanted.join(right, met, "left").withColumn("HAS_MDM_DATA", F.col("DIA").isNotNull()).drop("__key")


def sample_report(left: DataFrame, right: DataFrame, key: str = "NIO", prefix: str = "MDM_") -> DataFrame:
    """Right join on the normalised key, whose left side must be unique (checked by the plan itself, in its one pass over that side); rows without a partner keep the key and have empty left columns."""
    names = collision_names(left.columns, right.columns, [key], prefix)
    a = unique_rows(left.withColumn("__left", key_of(left, key, "digits_keep_zero")).filter("__left <> ''"), ["__left"])
    b = right.select(key_of(right, key, "digits_keep_zero").alias("__right"), F.col(key).alias("__name"), *(right[c].alias(n) for c, n in names.items()))
    met = a.join(b, F.col("__left") == F.col("__right"), "right")
    own = [F.coalesce(a[key], F.col("__name"), F.col("__right")).alias(key) if c == key else F.col(c) for c in left.columns]
    return met.select(*own, *names.values())


def export_join(left: DataFrame, right: DataFrame, key: str = "NIO", prefix: str = "MDM_") -> DataFrame:
    """Left join of two exported tables on the key without leading zeros; the right side must be unique."""
    return join_colliding(left, right, key, prefix, "zeros_only")


def daily_report(sources: Mapping[str, DataFrame], first: date | str, last: date | str, as_of: date | str, town: str | None = None, geo_how: str = "inner") -> DataFrame:
    """Registry, topology and series of all days of the period inside retention, all days at once.

    The units are written once and read by the steps that need them: topology and series ask for their keys, the report for their rows.
    """
    spark = next(iter(sources.values())).sparkSession
    base = upper_names(registry(sources, as_of, town))
    base = materialize(keep_first(base.withColumn("NIO", key_of(base, "NIO")), ["NIO"]), "registry")
    geo = topology(sources, base.select("UC"))
    base = materialize(join_prefixed(base.withColumn("UC", F.col("UC").cast("string")), geo.withColumn("UC", F.col("UC").cast("string")), "UC", "GEO_", geo_how), "units")
    wanted = days(spark, day_literal(first), day_literal(last)).filter(in_retention(F.col("day"), as_of))
    channels = {k: v.filter(F.col("tv").cast("date").between(day_literal(first), day_literal(last))) for k, v in sources.items() if "tv" in v.columns}
    daily = daily_table(channels, sources["a_data_catalogue"], distinct_keys(base, "NIO"))
    return report(base, daily, wanted)


def _attempt(run: Run, name: str, step: Callable[[], object]) -> bool:
    """Did ``step`` succeed? Its error is noted otherwise."""
    try:
        step()
    except Exception as e:
        run.error(name, str(e)[:2000])
        return False
    return True


def run_period(
    sources: Mapping[str, DataFrame], out: str, first: date | str, last: date | str, as_of: date | str, town: str | None = None, go_on: bool = False
) -> Run:
    """Publish the report of a period by day, a snapshot of the units of each day, each day's outcome, and the run's record.

    Report and snapshots become versions that cover the period: days that have no rows any more are not in them.

    All days are one job. If that fails, its error is noted and raised or, with ``go_on``, each day is tried by itself,
    so that one broken day costs no other. ``period_status`` under ``out`` gets the outcome of every day, with the run's duration.
    """
    spark = next(iter(sources.values())).sparkSession
    run, began = Run(spark), time.monotonic()

    def write(a: date | str, b: date | str) -> None:
        found = daily_report(sources, a, b, as_of, town).withColumnRenamed("REPORT_DAY", "report_day")
        found = materialize(found, "report")  # finding the ranges of the published files reads it once more
        run.publish("report", found, f"{out}/report", "report_day", ("NIO",), (a, b))

    written: list[tuple[str, str]] = [(str(first), str(last))]
    if not _attempt(run, "report", lambda: write(first, last)):
        if not go_on:
            run.save(f"{out}/runs")
            raise RuntimeError(f"report of {first} to {last}: {run.steps[-1][5]}")
        each = [str(r["day"]) for r in days(spark, day_literal(first), day_literal(last)).orderBy("day").collect()]  # a row a day
        written = [(d, d) for d in each if _attempt(run, f"report {d}", lambda d=d: write(d, d))]
    made = V.read(spark, f"{out}/report") if any(s[5] is None for s in run.steps) else None
    present = None
    if made is not None:
        present = made.filter(reduce(lambda x, y: x | y, (F.col("report_day").between(day_literal(a), day_literal(b)) for a, b in written)))
        for a, b in written:
            part = present.filter(F.col("report_day").between(day_literal(a), day_literal(b)))
            save_snapshots(part, f"{out}/daily_keys", a, b, "UC", "report_day")
    there = present.select(F.col("report_day").alias("day")) if present is not None else spark.createDataFrame([], "day date")
    status = period_status(spark, there, first, last, as_of).withColumns(
        {"run_id": F.lit(run.run_id), "duration_seconds": F.lit(round(time.monotonic() - began, 3))}
    )
    status.write.mode("append").parquet(f"{out}/period_status")
    run.save(f"{out}/runs")
    return run


def period_status(spark, present: DataFrame, first: date | str, last: date | str, as_of: date | str) -> DataFrame:
    """Each day of the period with its rows and status: skipped (outside retention), ok (rows), failed (none)."""
    rows = present.groupBy(F.col("day").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    met = days(spark, day_literal(first), day_literal(last)).join(rows, "day", "left")
    status = F.when(~in_retention(F.col("day"), as_of), "skipped").when(F.col("rows") > 0, "ok").otherwise("failed")
    return met.select("day", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def period_summary(status: DataFrame) -> DataFrame:
    """Days in all and by outcome; with the run's duration where ``status`` has it."""
    took = [F.max("duration_seconds").alias("duration_seconds")] if "duration_seconds" in status.columns else []
    return status.agg(
        F.count(F.lit(1)).alias("total_days"), *(F.count_if(F.col("status") == s).alias(f"{s}_days") for s in ("ok", "failed", "skipped")), *took
    )


def sample_flow(base: DataFrame, geo: DataFrame, daily: DataFrame, size: int = 200) -> tuple[DataFrame, DataFrame]:
    """A spread sample of meters, smart ones first, with topology and series; and the checks it has to pass before it is published."""
    keyed = base.withColumn("__nio", key_of(base, "NIO", "digits_keep_zero")).filter("__nio <> ''")
    candidates = keep_first(keyed, ["__nio"])
    smart = is_truthy(F.col("SMART")) if "SMART" in base.columns else None
    taken = spread_sample(candidates, size, [F.col("__nio")], smart).drop("__nio")
    out = sample_report(join_colliding(taken, geo, "UC", "GEO_"), daily)
    return out, verify_output(out, ["UC", "NIO"], size)
