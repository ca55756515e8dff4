"""Upkeep of the feature table: upsert, lookup, purge, change detection, link repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.paths import basename
from trackweave.functions.scalars import as_float, as_int
from trackweave.schema import INTEGER_MEASURES, MEASURES
from trackweave.session import BROADCAST_ROWS, settle, settle_small


def latest_per_key(rows: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """The first row of each key in ``newest_first`` order.

    Spark turns the filter on ``row_number`` into a per-task limit before the shuffle, so a
    key repeated by a third of the rows reaches its window as one row per map task.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def coerce_measures(rows: DataFrame) -> DataFrame:
    """Measures as the numbers the table stores; what is no number becomes 0."""
    return rows.withColumns(
        {c: as_int(F.col(c)) if c in INTEGER_MEASURES else as_float(F.col(c)) for c in MEASURES}
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """Old rows whose key is not in ``new``, and the newest row of every key in ``new``.

    ``old`` has one row per key already, so only ``new`` is ranked. The new keys are counted
    first: a small batch is broadcast and the old table is not shuffled at all.
    """
    replaced = settle_small(new.select(*keys).distinct())
    return old.join(replaced, keys, "left_anti").unionByName(latest_per_key(new, keys, newest_first))


def lookup(files: DataFrame, features: DataFrame) -> DataFrame:
    """Each listed file with its cached measures, if a row at least as new exists.

    ``files`` needs file_hash, file_path and last_modified. A hit keeps the current path.
    Hashes are unique in ``features``, so copies of one file multiply nothing. The distinct
    hashes are counted: when few, the table is filtered by them in its scan and what is left
    is broadcast, so neither side is shuffled; otherwise both are, and a hash that many
    files share is split by the adaptive skew join.
    """
    cached = features.select(
        "file_hash", F.col("last_modified").alias("cached_modified"), *MEASURES, F.lit(True).alias("found")
    )
    wanted = settle(files.select("file_hash").distinct())
    if wanted.count() <= BROADCAST_ROWS:
        cached = F.broadcast(cached.join(F.broadcast(wanted), "file_hash", "left_semi"))
    current = (files["file_hash"] == cached["file_hash"]) & (cached["cached_modified"] >= files["last_modified"])
    return (
        files.join(cached, current, "left")
        .drop(cached["file_hash"], "cached_modified")
        .withColumn("is_hit", F.coalesce("found", F.lit(False)))
        .withColumn("filename", basename(F.col("file_path")))
        .drop("found")
    )


def scan_features(features: DataFrame) -> DataFrame:
    """The path and all ten measures of every row; hashes and times are not read."""
    return features.select("file_path", *MEASURES)


def missing_rows(features: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file is not listed any more."""
    return features.join(listing.select("file_path").distinct(), "file_path", "left_anti")


def present_rows(features: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file is still listed."""
    return features.join(listing.select("file_path").distinct(), "file_path", "left_semi")


def changed_since(features: DataFrame, playlists: DataFrame, null_watermark: str = "none") -> DataFrame:
    """Rows analysed after the newest playlist update.

    Without any playlist the watermark is NULL and nothing counts as changed;
    ``null_watermark="all"`` takes every row instead.
    """
    watermark = playlists.agg(F.max("last_updated")).scalar()
    newer = F.col("last_analyzed") > watermark
    return features.where(newer | watermark.isNull() if null_watermark == "all" else newer)


def stamp_updated(playlists: DataFrame, moment: Column) -> DataFrame:
    """Playlists with one update time for all."""
    return playlists.withColumn("last_updated", moment)


def unlink_changed(links: DataFrame, features: DataFrame, changed: DataFrame) -> DataFrame:
    """Playlist links without those to a file among the ``changed`` paths."""
    touched = features.join(settle_small(changed.select("file_path").distinct()), "file_path", "left_semi")
    return links.join(settle_small(touched.select("file_hash").distinct()), "file_hash", "left_anti")


def orphan_links(links: DataFrame, playlists: DataFrame, features: DataFrame) -> DataFrame:
    """Links that point to no playlist or to no feature row, with the broken side named."""
    known = playlists.select(F.col("id").alias("playlist_id"))
    # Playlist ids repeat a lot: reduce them before joining, so no id is a hot join key.
    stray = settle_small(links.select("playlist_id").distinct().join(known, "playlist_id", "left_anti"))
    no_playlist = links.join(stray, "playlist_id", "left_semi").withColumn("broken", F.lit("playlist"))
    no_track = links.join(features.select("file_hash"), "file_hash", "left_anti")
    return no_playlist.unionByName(no_track.withColumn("broken", F.lit("track")))


def latest_per_path(features: DataFrame) -> DataFrame:
    """Only the newest row of each path: drops the stale row a changed file leaves behind."""
    return latest_per_key(features, ["file_path"], [F.desc("last_modified"), F.desc("ingest_seq")])


def failed_paths(*parts: DataFrame) -> DataFrame:
    """Distinct paths of several failure lists."""
    paths = parts[0].select("file_path")
    for part in parts[1:]:
        paths = paths.unionByName(part.select("file_path"))
    return paths.distinct()
