"""Checks of keys, outputs, dated files and periods. Every check gives rows; only ``require_unique`` and, when its rows are read, ``unique_rows`` raise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.calendar import day_literal, days, file_day
from meterlake.functions.keys import find_column, size_text
from meterlake.operators.sampling import median_of

#: Kinds of dated files.
FILE_KINDS = ("cis", "geo", "mdm", "timegrid", "model_input", "daily_report", "weather")


def file_patterns(prefix: str = "meter") -> dict[str, str]:
    """Patterns of file names by kind: prefix, kind, maybe a sample's size, the day, and csv or parquet."""
    return {kind: rf"^{prefix}_{kind}(_sample_\d+)?_\d{{8}}\.(csv|parquet)$" for kind in FILE_KINDS}


FILE_PATTERNS = file_patterns()
COVERAGE_DAYS, OUTLIER_STD, FRESH_DAYS, ROW_TOLERANCE = 30, 1.5, 3, 0.1


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; rows with a null or empty key are not counted."""
    rows = df.filter(reduce(lambda a, b: a & b, (F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in keys)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def top_duplicates(df: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    return duplicate_keys(df, keys).orderBy(F.col("n").desc(), *keys).limit(n)


def require_unique(df: DataFrame, keys: Sequence[str], shown: int = 10) -> DataFrame:
    """``df``, or an error that names some of the keys that repeat."""
    if found := top_duplicates(df, keys, shown).collect():
        raise ValueError("repeated keys: " + ", ".join("/".join(str(r[k]) for k in keys) + f" ({r['n']} rows)" for r in found))
    return df


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` as it is, in a plan that fails once a key repeats: no action of its own, and no second reading.

    Rows are counted over the key's own exchange, which a join on the same key shares. All keys count, null and empty ones too.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    said = F.concat(F.lit("repeated keys: "), F.concat_ws("/", *keys), F.lit(" ("), F.col("__n").cast("string"), F.lit(" rows)"))
    return df.withColumn("__n", n).filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).drop("__n")


def verify_output(df: DataFrame, keys: Sequence[str], expected_rows: int) -> DataFrame:
    """One row per check (``check``, ``passed``, ``detail``): columns, blank keys, row count, repeated keys."""
    found = {k: c for k in keys if (c := find_column(df, k))}
    text = {k: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for k, c in found.items()}
    rows = df.select(*(e.alias(f"k{i}") for i, e in enumerate(text.values())), F.lit(1).alias("one"))
    cols = [f"k{i}" for i in range(len(text))]
    counted = rows.groupBy(*cols).agg(F.count("one").alias("n"))  # one row for each different key
    totals = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"),
        *(F.coalesce(F.sum(F.when(F.col(c) == "", F.col("n"))), F.lit(0)).alias(f"blank_{c}") for c in cols),
    )
    tolerance = max(1, int(expected_rows * ROW_TOLERANCE))
    low, high = expected_rows - tolerance, expected_rows + tolerance
    missing = [k for k in keys if k not in found]
    blanks = F.concat_ws(", ", *(F.when(F.col(f"blank_{c}") > 0, F.format_string(f"{k}: %d", f"blank_{c}")) for k, c in zip(found, cols)))
    checks = [
        ("has_header", F.lit(bool(df.columns)), F.lit(f"{len(df.columns)} columns")),
        ("key_columns_present", F.lit(not missing), F.lit(f"missing: {', '.join(missing)}" if missing else f"{len(keys)} key columns")),
        ("no_nulls_in_keys", blanks == "", F.when(blanks == "", "no blank keys").otherwise(blanks)),
        ("row_count_coherent", F.col("rows").between(low, high), F.format_string(f"%d rows, expected {low} to {high}", "rows")),
        ("no_duplicates", (F.col("repeated") == 0) if found else F.lit(True), F.format_string("%d repeated rows", "repeated")),
    ]
    made = totals.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), p.alias("passed"), d.alias("detail")) for n, p, d in checks))).alias("x"))
    return made.select("x.*")


def match_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` that find ``key`` in ``right`` and rows that do not."""
    known = right.select(key).distinct().withColumn("__hit", F.lit(True))
    return left.join(known, key, "left").agg(
        F.count_if(F.col("__hit").isNotNull()).alias("matched"), F.count_if(F.col("__hit").isNull()).alias("unmatched")
    )


def missing_days(spark: SparkSession, present: DataFrame, first: Column, last: Column, day: str = "day") -> DataFrame:
    """Days of the period that ``present`` does not have."""
    return days(spark, first, last, day).join(present.select(F.col(day).cast("date").alias(day)).distinct(), day, "left_anti")


def coverage(present: DataFrame, first: Column | None = None, last: Column | None = None, day: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """One row (for each group): days in all and present, percent, complete, and the missing days.

    Without days present the period is complete with none of none, 0 percent, whatever its bounds; groups without days have no row.
    """
    have = present.select(*by, F.col(day).cast("date").alias("day")).filter("day IS NOT NULL").distinct()
    ends = have.groupBy(*by).agg(
        (F.min("day") if first is None else F.any_value(first)).alias("first"), (F.max("day") if last is None else F.any_value(last)).alias("last")
    )
    expected = ends.filter("first <= last").select(*by, F.explode(F.sequence("first", "last")).alias("day"))
    met = expected.join(have.withColumn("hit", F.lit(True)), [*by, "day"], "left")
    out = met.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_days"),
        F.count("hit").alias("covered_days"),
        F.sort_array(F.collect_list(F.when(F.col("hit").isNull(), F.col("day").cast("string")))).alias("missing"),
    )
    percent = F.when(F.col("total_days") > 0, F.round(100.0 * F.col("covered_days") / F.col("total_days"), 1)).otherwise(0.0)
    return out.select(
        *by, "total_days", "covered_days", percent.alias("coverage_percent"), (F.size("missing") == 0).alias("complete"), F.concat_ws(",", "missing").alias("missing")
    )


def size_stats(files: DataFrame, size: str = "size_bytes", day: str = "file_date") -> DataFrame:
    """Count, mean, sample deviation (0 for one), least, most, median, and the days of least and most among files that have a day."""
    dated = lambda x: F.when(F.col(day).isNotNull(), x)
    stats = files.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(size).alias("mean_bytes"),
        F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("std_bytes"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
        F.min_by(day, dated(F.struct(size, day))).alias("min_date"),
        F.max_by(day, dated(F.struct(F.col(size), -F.datediff(F.col(day), F.lit("1970-01-01"))))).alias("max_date"),
    )
    middle = median_of(files, size, "median_bytes")
    return stats.join(F.broadcast(middle), F.lit(True)).select(  # one row each
        "count", "mean_bytes", "std_bytes", "min_bytes", "max_bytes", "median_bytes", "min_date", "max_date"
    )


def size_outliers(files: DataFrame, threshold: float = OUTLIER_STD, size: str = "size_bytes") -> DataFrame:
    """Files outside mean ± threshold deviations; none if sizes do not vary."""
    stats = files.agg(F.avg(size).alias("__mean"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("__std"))
    low = F.greatest(F.lit(0.0), F.col("__mean") - threshold * F.col("__std"))
    far = (F.col(size) < low) | (F.col(size) > F.col("__mean") + threshold * F.col("__std"))
    return files.crossJoin(F.broadcast(stats)).filter((F.col("__std") > 0) & far).drop("__mean", "__std")


def freshness(df: DataFrame, as_of: date | str, group: Sequence[str] = (), day: str = "day", most: int = FRESH_DAYS) -> DataFrame:
    """The newest day (of each group), its age in days, and whether that is at most ``most``."""
    newest = df.groupBy(*group).agg(F.max(day).cast("date").alias("newest"))
    age = F.datediff(day_literal(as_of), "newest")
    return newest.select(*group, "newest", age.alias("age_days"), F.coalesce(age <= most, F.lit(False)).alias("fresh"))


def name_is_valid(name: Column, patterns: Mapping[str, str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, (name.rlike(p) for p in (patterns or FILE_PATTERNS).values()))


def named_files(files: DataFrame, name: str = "name", patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Files whose names are checked (csv and parquet, not hidden), with ``file_date`` and ``valid``."""
    c = F.col(name)
    checked = files.filter(c.rlike(r"\.(csv|parquet)$") & ~c.startswith(".") & ~c.startswith("_"))
    return checked.withColumns({"file_date": file_day(c), "valid": name_is_valid(c, patterns) & file_day(c).isNotNull()})


def days_back_consistent(files: DataFrame, expected: Column, name: str = "name") -> DataFrame:
    """Does the day in each file's name equal the expected one?"""
    found = file_day(F.col(name))
    state = F.when(found.isNull(), "no day in the name").when(found == expected, "as expected").otherwise("another day")
    return files.withColumns({"file_date": found, "expected_date": expected, "valid": F.coalesce(found == expected, F.lit(False)), "message": state})


def naming_check(files: DataFrame, name: str = "name") -> DataFrame:
    bad = named_files(files, name).agg(F.count_if(~F.col("valid")).alias("n"), F.count(F.lit(1)).alias("total"))
    return bad.select(
        F.lit("file_naming").alias("check"), (F.col("n") == 0).alias("passed"), F.format_string("%d of %d names are invalid", "n", "total").alias("detail")
    )


def coverage_check(present: DataFrame, as_of: date | str, days_back: int = COVERAGE_DAYS, day: str = "day") -> DataFrame:
    """Are all days from yesterday back ``days_back`` days there? Nothing there at all passes: there is nothing to check."""
    last = F.date_sub(day_literal(as_of), 1)
    return coverage(present, F.date_sub(last, days_back), last, day).select(
        F.lit("period_coverage").alias("check"),
        F.col("complete").alias("passed"),
        F.format_string("%d of %d days, missing: %s", "covered_days", "total_days", F.concat_ws(",", F.slice(F.split("missing", ","), 1, 5))).alias("detail"),
    )


def size_check(files: DataFrame, size: str = "size_bytes") -> DataFrame:
    outliers = size_outliers(files, size=size).agg(F.count(F.lit(1)).alias("n"))
    stats = files.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean"))
    return outliers.crossJoin(stats).select(
        F.lit("file_sizes").alias("check"),
        (F.col("n") == 0).alias("passed"),
        F.concat(F.format_string("%d outliers among %d files, mean ", "n", "count"), size_text(F.round("mean").cast("long"))).alias("detail"),
    )


def freshness_check(df: DataFrame, as_of: date | str, day: str = "day") -> DataFrame:
    return freshness(df, as_of, day=day).select(
        F.lit("ucs_file").alias("check"),
        F.col("fresh").alias("passed"),
        F.coalesce(F.format_string("newest %s, %d days old", F.col("newest").cast("string"), F.col("age_days")), F.lit("none")).alias("detail"),
    )


def folder_files(files: DataFrame, prefix: str = "meter", suffix: str = ".csv") -> DataFrame:
    """Dated folders (as of ``sources.files.dated_folders``) as one file a day: ``name`` as the patterns want it, ``size_bytes``."""
    name = F.concat(F.lit(f"{prefix}_"), "dataset", F.lit("_"), F.date_format("day", "yyyyMMdd"), F.lit(suffix))
    return files.select(name.alias("name"), "size_bytes", "dataset", "day")


def of_kind(files: DataFrame, kind: str, prefix: str = "meter", suffix: str = ".csv", name: str = "name") -> DataFrame:
    """Files of one kind, by the beginning and end of their names."""
    return files.filter(F.col(name).startswith(f"{prefix}_{kind}") & F.col(name).endswith(suffix))


def integrity_report(
    files: DataFrame, snapshots: DataFrame, as_of: date | str, days_back: int = COVERAGE_DAYS, kind: str = "cis", prefix: str = "meter"
) -> DataFrame:
    """The four checks, one row each. ``files``: name, size_bytes; ``snapshots``: day.

    All names are checked; days and sizes are those of one ``kind`` of file, so that no other file of a day hides a missing one.
    """
    one = of_kind(files, kind, prefix)
    checks = [
        naming_check(files),
        coverage_check(one.select(file_day(F.col("name")).alias("day")), as_of, days_back),
        size_check(one),
        freshness_check(snapshots, as_of),
    ]
    return reduce(DataFrame.unionByName, checks)


def summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )
