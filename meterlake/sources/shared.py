"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine the warehouse where that is unset, on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def job_dir(spark: SparkSession) -> str:
    """The folder of this application's tables under ``shared_dir``."""
    return f"{shared_dir(spark)}/meterlake-{spark.sparkContext.applicationId}"


def clear_job(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised; call it once their readers are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(job_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then depend on files that every executor can read, not on shuffle
    files of executors that may be lost. They stay until ``clear_job``, as results are read lazily.
    """
    spark = df.sparkSession
    path = f"{job_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
