"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.session import store

__all__ = ["blocks", "documents", "spread", "store", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns with any name cannot clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def utf8(column: pa.Array) -> list[bytes]:
    """Text column of an Arrow batch as UTF-8 bytes; null counts as empty."""
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text ``column`` has about ``limit`` bytes at most; a longer row comes alone.

    Bounds what a task holds at a time, whatever the number of rows in a batch.
    """
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def spread(df: DataFrame) -> int:
    """Tasks for a shuffle that must not be merged into fewer by their bytes: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
