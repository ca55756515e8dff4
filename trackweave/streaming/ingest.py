"""Feature rows and files arriving as streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackweave.functions.paths import is_audio
from trackweave.operators import cache as C
from trackweave.operators.extraction import Extractor, extract_measures
from trackweave.session import store
from trackweave.sources.files import big_enough, describe_files, too_small
from trackweave.sources.listing import changed_files
from trackweave.sources.table import FeatureTable, KeyedTable


def stream_name(checkpoint: str) -> str:
    """A stream's mark in the table: batches are numbered for each checkpoint folder."""
    return hashlib.md5(checkpoint.encode()).hexdigest()


def upsert_stream(
    rows: DataFrame, table: KeyedTable, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Upsert every micro-batch of ``rows`` into ``table``.

    A batch rewrites the buckets its keys fall into, and counts once even if it is replayed. Which row
    of a key is newest is decided by the table (``newest_by``), within and across batches: late rows
    never win.
    """

    def take(batch: DataFrame, number: int) -> None:
        table.append(batch, stream_name(checkpoint), number)

    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def fresh_rows(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows of a stream, each of ``keys`` once, without those that come later than ``delay`` behind the newest.

    Keys are remembered as state until the watermark has passed them by ``delay``, so a repeated row is dropped
    whatever its batch, and the state is as long as the delay and not as the stream.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def save_stream(rows: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet folder; every batch counts once."""
    query = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def watch_directory(
    spark: SparkSession,
    music_dir: str,
    features: FeatureTable,
    failures: str,
    extractor: Extractor,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Measure files as they appear or change below ``music_dir``; unchanged ones are skipped, hidden names are taken.

    Failed paths go to the Parquet folder ``failures``, one subfolder per batch.
    """
    stream = changed_files(spark, music_dir)

    def take(batch: DataFrame, number: int) -> None:
        audio = describe_files(batch).where(is_audio(F.col("file_path")))
        found = C.lookup(big_enough(audio), features.read()).where("NOT is_hit").select(*audio.columns)
        fresh = store(extract_measures(found, extractor))
        good = C.coerce_measures(fresh.where("error IS NULL").drop("error", "length"))
        stamped = good.withColumn("last_analyzed", F.current_timestamp().cast("timestamp_ntz"))
        features.append(stamped, stream_name(checkpoint), number)
        small = too_small(audio).select("file_path", F.lit("too small").alias("error"))
        failed = fresh.where("error IS NOT NULL").select("file_path", "error").unionByName(small)
        failed.write.mode("overwrite").parquet(f"{failures}/batch={number}")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()
