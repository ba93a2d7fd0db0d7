"""Stages: results that are written once and read again."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "parlance-stages"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """The rows from the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; it is built and written if it isn't there.  A half-written table has no _SUCCESS and is built again."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run hasn't finished, by the keys that it wrote."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
