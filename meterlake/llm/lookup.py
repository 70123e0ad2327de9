"""Joins of whole texts with a table that few of them meet, without a shuffle of the others.

The small table is written first, so its size is known. Up to ``BROADCAST_BYTES`` it is broadcast. A larger one is
turned into a Bloom filter of its keys (bounded, see ``bitmap``): rows whose keys are not in it pass by, and only the
others, with the filter's few false hits, meet the table in a join. Results are the same either way.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.bitmap import bits_for, build, contains
from meterlake.llm.shared import materialize

#: Bytes of a table that is broadcast, and bits of a filter, at most (16 and 32 MB).
BROADCAST_BYTES, FILTER_BITS = 1 << 24, 1 << 28
#: Bytes that a row costs beside its texts.
ROW = 64


def _size(small: DataFrame) -> tuple[int, int]:
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in small.dtypes if kind in ("string", "binary")]
    count, texts = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(wide, F.lit(0)).cast("bigint")), F.lit(0))).first()
    return count, count * ROW + texts


def _may_meet(small: DataFrame, keys: Sequence[str], count: int) -> Column:
    hashed = small.select(F.xxhash64(*keys).alias("key"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    shared = small.sparkSession.sparkContext.broadcast(build(hashed, bits_for(count, FILTER_BITS)))

    @F.pandas_udf("boolean")
    def hit(key: pd.Series) -> pd.Series:
        return pd.Series(contains(shared.value, key.to_numpy().astype(np.int64).view(np.uint64)))

    return hit(F.xxhash64(*keys))


def attach(rows: DataFrame, small: DataFrame, keys: Sequence[str], most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the other columns of ``small`` (one row a key, no nulls in it), null where there is no such key."""
    keys = list(keys)
    small = materialize(small, "small")
    count, size = _size(small)
    if size <= most:
        return rows.join(F.broadcast(small), keys, "left")
    marked = rows.withColumn("__may", _may_meet(small, keys, count))
    met = marked.filter("__may").drop("__may").join(small, keys, "left")
    rest = [F.lit(None).cast(small.schema[c].dataType).alias(c) for c in small.columns if c not in keys]
    return met.unionByName(marked.filter(~F.col("__may")).drop("__may").select("*", *rest))


def without(rows: DataFrame, gone: DataFrame, key: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` but those whose ``key`` is in the one column of ``gone``; a null in it takes the rows without a key away."""
    gone = materialize(gone.toDF("__gone").distinct(), "gone")
    if not gone.filter("__gone IS NULL").isEmpty():
        rows = rows.filter(F.col(key).isNotNull())
    gone = gone.filter("__gone IS NOT NULL")
    count, size = _size(gone)
    if size <= most:
        return rows.join(F.broadcast(gone), rows[key] == F.col("__gone"), "left_anti")
    kind = gone.schema["__gone"].dataType
    marked = rows.withColumn("__key", F.col(key).cast(kind))
    marked = marked.withColumn("__may", F.col("__key").isNotNull() & _may_meet(gone.withColumnRenamed("__gone", "__key"), ["__key"], count))
    left = marked.filter("__may").join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    return left.unionByName(marked.filter(~F.col("__may"))).drop("__key", "__may")
