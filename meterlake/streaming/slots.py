"""Readings as a stream: the highest value of each key and 5-minute slot, late ones up to a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def slot_stream(readings: DataFrame, keys: Sequence[str], measures: Sequence[str], ts: str = "tv", late: str = "15 minutes", slot: str = "5 minutes") -> DataFrame:
    """Keys, ``tv`` (the slot's start), measures. State holds the slots that the watermark has not passed."""
    rows = readings.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    found = rows.groupBy(*keys, F.window("__ts", slot).alias("w")).agg(*(F.max(m).alias(m) for m in measures))
    return found.select(*keys, F.col("w.start").alias("tv"), *measures)


def start_slots(
    readings: DataFrame, target: str, checkpoint: str, keys: Sequence[str], measures: Sequence[str], ts: str = "tv", late: str = "15 minutes", slot: str = "5 minutes", once: bool = True
) -> StreamingQuery:
    """Start the slot table as a query that can be stopped, or lost, and started again from ``checkpoint``.

    Each micro-batch writes the slots that it changed, with their values so far, as ``batch=<number>`` under ``target``. A batch that
    is run again after a failure overwrites its own folder and nothing else, so ``current_slots`` sees each slot once whatever
    happened between write and commit. ``once``: take what is there now and end.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    found = slot_stream(readings, keys, measures, ts, late, slot)
    writer = found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_slots(spark: SparkSession, target: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Each slot as the last batch that changed it left it."""
    rows = spark.read.parquet(target)
    last = rows.groupBy(*keys, "tv").agg(F.max_by(F.struct(*measures), "batch").alias("last"))
    return last.select(*keys, "tv", "last.*")


def compact_slots(spark: SparkSession, target: str, into: str, keys: Sequence[str], measures: Sequence[str]) -> None:
    """Write the current slots as one table: each batch's rows are read once, later readers read a slot once."""
    current_slots(spark, target, keys, measures).write.mode("overwrite").parquet(into)
