"""Cutting lineage by a table in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made by this driver, in order of their making; results read them, so they stay until remove() is called.
CREATED: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder; on a cluster there is none to choose.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="treeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    CREATED.append(f"{base.rstrip('/')}/treeloom/{name}-{uuid.uuid4().hex}")
    return CREATED[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in CREATED:
        CREATED.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a work folder and read again: iterations don't pile up plans, and lost executors lose nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
