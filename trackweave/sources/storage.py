"""Small metadata calls on any Hadoop file system (local, HDFS, object store)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def child_names(spark: SparkSession, text: str) -> list[str]:
    path, fs = _path(spark, text)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def delete(spark: SparkSession, text: str) -> None:
    path, fs = _path(spark, text)
    fs.delete(path, True)
