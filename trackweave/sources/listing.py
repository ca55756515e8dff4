"""A folder as a stream of the files that appear or change in it, by listing; names are no obstacle.

An offset is a point in time: a batch has the files modified after the last one, up to a moment before now. The
driver lists the top folder alone; every folder in it is listed by a task of its own.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from trackweave.sources.m3u import open_filesystem, outer_path

# Seconds that a file must be old: later ones may still be written to, or stamped by a clock that is behind.
SETTLED = 0.0
ROWS = 10_000


@dataclass
class Span(InputPartition):
    """Files of a folder, with those of its folders if ``deep``, modified after ``start`` up to ``end`` (nanoseconds)."""

    folder: str
    deep: bool
    start: int
    end: int


class ListingReader(DataSourceStreamReader):
    def __init__(self, folder: str, settled: float):
        self.folder, self.settled = folder.rstrip("/") or "/", settled

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settled * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        fs, inner = open_filesystem(self.folder)
        infos = fs.get_file_info(pafs.FileSelector(inner))
        folders = [outer_path(self.folder, i.path) for i in infos if i.type == pafs.FileType.Directory]
        span = (start["until"], end["until"])
        return [Span(self.folder, False, *span), *(Span(f, True, *span) for f in folders)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, inner = open_filesystem(partition.folder)
        infos = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True, recursive=partition.deep))
        files = [i for i in infos if i.type == pafs.FileType.File and partition.start < (i.mtime_ns or 0) <= partition.end]
        for at in range(0, len(files), ROWS):
            part = files[at : at + ROWS]
            yield pa.record_batch(
                [
                    pa.array([outer_path(partition.folder, i.path) for i in part], pa.string()),
                    pa.array([i.size for i in part], pa.int64()),
                    pa.array([(i.mtime_ns or 0) // 1000 for i in part], pa.timestamp("us", "UTC")),
                ],
                ["path", "length", "modificationTime"],
            )


class FileListing(DataSource):
    """``spark.readStream.format("file_listing").load(folder)``; option ``settled`` in seconds."""

    @classmethod
    def name(cls):
        return "file_listing"

    def schema(self):
        return "path string, length bigint, modificationTime timestamp"

    def streamReader(self, schema):
        return ListingReader(self.options["path"], float(self.options.get("settled", SETTLED)))


def changed_files(spark: SparkSession, folder: str, settled: float = SETTLED) -> DataFrame:
    """A stream of (path, length, modificationTime): files below ``folder`` that are new or changed since the last batch.

    A file moved in with an old time is not seen; a run over the whole listing takes it.
    """
    spark.dataSource.register(FileListing)
    return spark.readStream.format("file_listing").option("settled", settled).load(folder)
