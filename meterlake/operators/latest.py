"""Records with validity, and the latest one of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_open(end: Column) -> Column:
    return end.isNull()


def valid_in_month(start: Column, end: Column, month: Column) -> Column:
    """Begun by the month's first day and not ended before it."""
    return F.coalesce(end >= month, F.lit(True)) & (start <= month)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``; say where nulls go in each term."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def latest_open_first(df: DataFrame, keys: Sequence[str], start: str, end: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Open records before ended ones, then the latest end, then the latest start."""
    order = [F.when(F.col(end).isNull(), 1).otherwise(2), F.col(end).desc_nulls_first(), F.col(start).desc_nulls_first(), *ties]
    return latest(df, keys, order)


def latest_by_end(df: DataFrame, keys: Sequence[str], start: str, end: str, ties: Sequence[Column] = ()) -> DataFrame:
    """The latest end, a missing one counting as the end of time, then the latest start."""
    forever = F.lit("2999-12-31").cast(df.schema[end].dataType)
    return latest(df, keys, [F.coalesce(F.col(end), forever).desc_nulls_first(), F.col(start).desc_nulls_first(), *ties])
