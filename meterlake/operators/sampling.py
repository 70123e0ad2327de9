"""A spread sample: rows at even distances in source order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.sources.shared import materialize


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Each row's position from 0 in ``order``, without bringing all rows into one partition.

    Rows are dealt by range, written with their partition's number, and numbered inside
    it; the partitions' counts (one row each) give the offsets.
    """
    terms = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    names = [f"__o{i}" for i in range(len(order))]
    ranged = df.select("*", *terms).repartitionByRange(*names)
    dealt = materialize(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    local = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*names)))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    met = local.join(F.broadcast(offsets), "__part")  # a row for each partition
    return met.withColumn(name, F.col("__before") + F.col("__n") - 1).drop("__part", "__n", "__before", *names)


def median_of(df: DataFrame, column: str, name: str = "median") -> DataFrame:
    """One row with the exact median of ``column`` without nulls (null if nothing is left), with no task that holds all values.

    Different values are counted, dealt by range and summed up inside each range; the ranges' sums (one row each)
    tell which of them holds the middle.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    dealt = materialize(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("rows"))
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy()).alias("total"),
    )
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(offsets), "part")  # a row for each partition
    end = F.col("before") + F.col("upto")
    holds = lambda at: (end - F.col("n") <= at) & (at < end)
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return ranked.filter(holds(low) | holds(high)).agg(F.avg("v").alias(name))


def spread_positions(k: Column, n: Column) -> Column:
    """Positions of ``k`` of ``n`` rows: all, the middle one, or round(i (n-1) / (k-1)), halves to even."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.rint(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("bigint"))
    return (
        F.when((k <= 0) | (n <= 0), F.array().cast("array<bigint>"))
        .when(k >= n, F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))))
        .when(k == 1, F.array(F.floor(n / 2).cast("bigint")))
        .otherwise(spread)
    )


def spread_sample(df: DataFrame, size: int, order: list[Column], preferred: Column | None = None) -> DataFrame:
    """``size`` rows spread over ``order``: preferred rows first, the rest filled from the others."""
    first = F.coalesce(preferred, F.lit(False)) if preferred is not None else F.lit(False)
    groups = df.withColumn("__first", first)
    numbered = {flag: with_ordinal(groups.filter(F.col("__first") == flag), order, "__ordinal") for flag in (True, False)}
    totals = groups.agg(F.count_if("__first").alias("p"), F.count_if(~F.col("__first")).alias("q")).select(
        "p", "q", F.least(F.col("p"), F.lit(size)).cast("bigint").alias("k")
    )
    taken = []
    for flag, n, k in ((True, F.col("p"), F.col("k")), (False, F.col("q"), F.lit(size).cast("bigint") - F.col("k"))):
        positions = totals.select(F.explode(spread_positions(k, n)).alias("__ordinal"))
        taken.append(numbered[flag].join(positions, "__ordinal", "left_semi"))
    return taken[0].unionByName(taken[1]).drop("__first", "__ordinal")
