"""Files: delimited text, lists, inventories, dated tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions.calendar import day_literal


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ";") -> DataFrame:
    """Delimited text with a header, all columns text; a byte-order mark is dropped from the first name."""
    reader = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    if columns is not None:
        return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    df = reader.option("inferSchema", False).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", True).option("escape", '"').csv(path)


def write_list(df: DataFrame, column: str, path: str) -> None:
    """One value per line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_dated(
    df: DataFrame,
    path: str,
    day: str = "report_day",
    order: Sequence[str] = (),
    csv_path: str | None = None,
    counted: Observation | None = None,
) -> None:
    """Parquet (and delimited text) partitioned by day; only the days in ``df`` are replaced. Rows are sorted inside files.

    ``counted`` gets the rows of the Parquet write. It is attached after the exchange: finding ranges reads the rows before it once more.
    """
    rows = df.repartitionByRange(day, *order).sortWithinPartitions(day, *order) if order else df.repartition(day)
    for target, kind in ((path, "parquet"), (csv_path, "csv")):
        if target:
            seen = rows.observe(counted, F.count(F.lit(1)).alias("rows")) if counted and kind == "parquet" else rows
            w = seen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).format(kind)
            (w.option("sep", ";").option("header", True).option("escape", '"') if kind == "csv" else w).save(target)


def read_days(spark: SparkSession, path: str, first: date | str, last: date | str, day: str = "report_day") -> DataFrame:
    """Days of a table written by ``write_dated``; only their partitions are read, and absent days are simply not there."""
    return spark.read.parquet(path).filter(F.col(day).between(day_literal(first), day_literal(last)))


def on_days(rows: DataFrame, wanted: DataFrame, day: str = "report_day") -> DataFrame:
    """Rows of a table by day whose day is in ``wanted`` (one column). Partitions are pruned while the query runs, by the days that it finds."""
    few = wanted.select(F.col(wanted.columns[0]).cast("date").alias(day)).distinct()  # a row a day
    return rows.join(F.broadcast(few), day, "left_semi").select(*rows.columns)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def inventory(spark: SparkSession, glob: str) -> DataFrame:
    """``path``, ``name``, ``size_bytes``, ``modified`` of files, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def dated_folders(files: DataFrame) -> DataFrame:
    """``dataset``, ``day``, ``size_bytes``, ``files``, ``modified`` of folders like .../dataset/day=2024-01-31/, from an inventory: no data is opened."""
    part = r"/([^/]+)/[^/=]+=(\d{4}-\d{2}-\d{2})/[^/]+$"
    found = files.select(F.regexp_extract("path", part, 1).alias("dataset"), F.try_to_date(F.nullif(F.regexp_extract("path", part, 2), F.lit(""))).alias("day"), "size_bytes", "modified")
    by_day = found.filter("dataset <> ''").groupBy("dataset", "day")
    return by_day.agg(F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("files"), F.max("modified").alias("modified"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, fetch: int = 1000, **options: str) -> DataFrame:
    """A table or query of a database, in ``parts`` ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
    if column and parts > 1:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()


def read_jdbc_keys(
    spark: SparkSession, url: str, table: str, column: str, keys: DataFrame, staging: str, parts: int = 8, fetch: int = 1000, expression: str | None = None,
    key_type: str | None = None, **options: str,
) -> DataFrame:
    """The rows of a database table whose ``column`` is in ``keys`` (one column); the database looks the keys up, no other row leaves it.

    Keys go into the table ``staging``, each once, with a part number from their hash; it is written anew by each call with this name. Each Spark partition then
    asks for one part's rows, by a join inside the database. However long the list is, it never passes the driver.
    ``expression`` says how the database makes a key of the table's row ``t``, if it is not the column itself; ``key_type`` is the
    database's type for keys (text keys need one that can be compared, such as VARCHAR(40)).
    """
    listed = keys.select(F.col(keys.columns[0]).alias("key")).filter("key IS NOT NULL").distinct()
    listed = listed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    declared = {"createTableColumnTypes": f"key {key_type}"} if key_type else {}
    write_jdbc(listed, url, staging, "overwrite", fetch, **options, **declared)
    quoted = f"(SELECT t.*, k.\"part\" FROM {table} t JOIN {staging} k ON {expression or f't."{column}"'} = k.\"key\") keyed"
    connection = {"fetchsize": str(fetch), **options}
    found = spark.read.jdbc(url, quoted, predicates=[f'"part" = {n}' for n in range(parts)], properties=connection)
    return found.drop("part")
