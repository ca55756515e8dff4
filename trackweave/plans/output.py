"""Playlist files and run counters out of flat playlist tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.paths import host_path, sanitise_name
from trackweave.session import store
from trackweave.sources.m3u import LINES_PER_PART, write_m3u

ALL_TRACKS = "All_Successful_Tracks"
FAILED_FILES = "Failed_Files"


def all_tracks(tracks: DataFrame, summary: DataFrame) -> DataFrame:
    """Every playlist's tracks in playlist order, duplicates kept, with global ``all_pos``.

    The global position is the playlist's start (a running sum over the summary, one row
    per playlist) plus the position inside it: nothing is sorted here.
    """
    before = Window.orderBy("playlist_order").rowsBetween(Window.unboundedPreceding, -1)
    starts = summary.select(
        "playlist", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start")
    )
    return (
        tracks.join(F.broadcast(starts), "playlist")
        .withColumn("all_pos", F.col("start") + F.col("pos"))
        .drop("start")
    )


def clean_file_names(summary: DataFrame) -> DataFrame:
    """(playlist, name): names without special characters, still one for each playlist.

    Playlists whose cleaned names meet get a mark of their own name; one that had the plain
    name all along keeps it.
    """
    cleaned = summary.select("playlist", sanitise_name(F.col("playlist")).alias("name"))
    several = F.count("*").over(Window.partitionBy("name")) > 1
    mark = F.concat_ws("_", "name", F.substring(F.md5("playlist"), 1, 8))
    return cleaned.select(
        "playlist", F.when(several & (F.col("name") != F.col("playlist")), mark).otherwise(F.col("name")).alias("name")
    )


def save_playlists(
    tracks: DataFrame,
    summary: DataFrame,
    output_dir: str,
    source_root: str = "",
    host_root: str = "",
    clean_names: bool = False,
    strict_prefix: bool = False,
    layout: str = "single",
    lines_per_part: int = LINES_PER_PART,
) -> None:
    """Every playlist in order and one list of all tracks, in a single shuffle; see ``sources.m3u`` for layouts."""
    placed = all_tracks(tracks, summary)
    if clean_names:
        placed = placed.join(F.broadcast(clean_file_names(summary)), "playlist")
    else:
        placed = placed.withColumn("name", F.col("playlist"))
    own = F.struct(F.col("name").alias("playlist"), "pos")
    every = F.struct(F.lit(ALL_TRACKS).alias("playlist"), F.col("all_pos").alias("pos"))
    line = host_path(F.col("file_path"), source_root, host_root, strict_prefix).alias("line")
    write_m3u(placed.select(line, F.inline(F.array(own, every))), output_dir, layout, lines_per_part)


def ordered_lines(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """(line, pos): distinct lines in order, sorted by many tasks.

    Ranges of lines are sorted each by a task; a line's position is its place there and the lines of the ranges before.
    """
    width = tasks or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.select("line").distinct().repartitionByRange(width, "line").sortWithinPartitions("line")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = store(ranged.select("line", F.spark_partition_id().alias("range"), place.alias("place")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(ranges), "range").select("line", (F.col("start") + F.col("place") + 1).alias("pos"))


def save_failed(
    failed: DataFrame,
    output_dir: str,
    source_root: str = "",
    host_root: str = "",
    strict_prefix: bool = False,
    layout: str = "single",
    lines_per_part: int = LINES_PER_PART,
) -> int:
    """The distinct failed paths in order, in either layout; nothing is written without any. Returns their number."""
    line = host_path(F.col("file_path"), source_root, host_root, strict_prefix).alias("line")
    paths = failed.select("file_path").distinct()
    rows = ordered_lines(paths.select(line)).select(F.lit(FAILED_FILES).alias("playlist"), "pos", "line")
    count = paths.count()
    if count:
        write_m3u(rows, output_dir, layout, lines_per_part)
    return count


def run_counts(summary: DataFrame, analysed: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: files analysed, files failed, playlists saved, tracks saved."""
    return summary.agg(
        F.count("*").alias("saved_playlists"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("saved_tracks")
    ).select(
        analysed.agg(F.count("*")).scalar().alias("ok_files"),
        failed.select("file_path").distinct().agg(F.count("*")).scalar().alias("failed_files"),
        "saved_playlists",
        "saved_tracks",
    )
