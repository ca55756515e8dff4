"""Music files as rows: recursive listing, metadata and content keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.paths import file_key
from trackweave.session import store
from trackweave.sources.m3u import open_filesystem, outer_path

# Fixed value: smaller files cannot hold audio.
MIN_BYTES = 1024


LISTED = "path string, length bigint, modificationTime timestamp, folder boolean"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            fs, inner = open_filesystem(folder)
            infos = fs.get_file_info(pafs.FileSelector(inner))
            infos = [i for i in infos if i.type in (pafs.FileType.File, pafs.FileType.Directory)]
            is_folder = [i.type == pafs.FileType.Directory for i in infos]
            micros = [None if i.mtime_ns is None else i.mtime_ns // 1000 for i in infos]
            columns = [
                pa.array([outer_path(folder, i.path) for i in infos], pa.string()),
                pa.array([0 if f else i.size for f, i in zip(is_folder, infos)], pa.int64()),
                pa.array(micros, pa.timestamp("us", "UTC")),
                pa.array(is_folder, pa.bool_()),
            ]
            yield pa.record_batch(columns, ["path", "length", "modificationTime", "folder"])


def describe_files(files: DataFrame) -> DataFrame:
    """path, length, modificationTime -> file_path, length, last_modified, file_hash."""
    micros = F.unix_micros("modificationTime")
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("file_path"),
        "length",
        F.coalesce(micros / F.lit(1e6), F.lit(0.0)).alias("last_modified"),
        file_key(F.regexp_replace("path", "^file:/+", "/"), F.col("length"), micros).alias("file_hash"),
    )


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """All files below ``directory``, whatever their names; their content is not read.

    Folders are listed in tasks, one level after the other; the levels are stored, so the driver
    holds no names. A missing ``directory`` is an error.
    """
    level = spark.createDataFrame([(directory.rstrip("/") or "/",)], "path string")
    files = []
    while True:
        found = store(level.mapInArrow(_listed, LISTED))
        files.append(found.where("NOT folder").drop("folder"))
        level = found.where("folder").select("path")
        if level.isEmpty():
            break
        # By a count of its own: adaptive execution would put all paths into one task.
        level = level.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return describe_files(reduce(DataFrame.union, files))


def big_enough(files: DataFrame) -> DataFrame:
    return files.where(F.col("length") >= MIN_BYTES)


def too_small(files: DataFrame) -> DataFrame:
    return files.where(F.col("length") < MIN_BYTES)
