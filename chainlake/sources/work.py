"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else, for local masters only, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'chainlake-work')}"
    return f"{base.rstrip('/')}/ledger-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder, read back: later steps start from its files, also after executors are lost."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete this application's tables in the folder. Call it after the results have been written."""
    remove(spark, folder(spark))


def swap(spark: SparkSession, new: str, old: str) -> None:
    """Put the table at `new` in the place of `old` by renames: readers see one or the other, never half a table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = path(f"{old}.{uuid.uuid4().hex[:8]}.old")
    had = fs.exists(path(old))
    if had and not fs.rename(path(old), aside):
        raise OSError(f"can't move {old} aside")
    if not fs.rename(path(new), path(old)):
        if had:
            fs.rename(aside, path(old))
        raise OSError(f"can't put {new} in the place of {old}")
    if had:
        fs.delete(aside, True)
