"""Sinks and the place for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder for tables that other tasks read again.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Where
    that is unset, a local master gets a temporary one, once for the session;
    on a cluster it is an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shiftspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines; NULLs are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def stored(df: DataFrame, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Writes a table and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
