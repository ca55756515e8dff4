"""Run modes: analyse and cluster, from cache, and incremental update."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.operators import cache as C
from trackweave.operators.clustering import NUM_PLAYLISTS, cluster_playlists
from trackweave.operators.extraction import Extractor, extract_measures, fill_required
from trackweave.operators.grouping import GroupingRules, rule_playlists
from trackweave.plans.output import save_failed, save_playlists
from trackweave.schema import MEASURES, PLAYLIST_TRACKS_SCHEMA, PLAYLISTS_SCHEMA
from trackweave.session import settle, settle_small, store
from trackweave.sources.files import big_enough, list_files, too_small
from trackweave.sources.table import FeatureTable, KeyedTable
from trackweave.functions.paths import is_audio


def now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")



class Workspace:
    """The three tables a music collection keeps below one cache folder."""

    def __init__(self, spark: SparkSession, cache_dir: str):
        root = cache_dir.rstrip("/")
        self.features = FeatureTable(spark, f"{root}/features")
        self.playlists = KeyedTable(spark, f"{root}/playlists", PLAYLISTS_SCHEMA, ["id"], ["last_updated"])
        self.links = KeyedTable(
            spark, f"{root}/playlist_tracks", PLAYLIST_TRACKS_SCHEMA, ["playlist_id", "file_hash"], ["added"]
        )


@dataclass(frozen=True)
class RunReport:
    """What a run did; ``failed_files`` counts distinct paths."""

    ok_files: int
    failed_files: int
    purged_files: int
    saved_playlists: int
    saved_tracks: int


def purge(workspace: Workspace, listing: DataFrame, music_dir: str, everywhere: bool = False) -> DataFrame:
    """Drop feature rows of files gone from ``music_dir``; returns their paths.

    Rows of files elsewhere are kept, since the listing says nothing about them; with ``everywhere``
    they go too. An empty listing
    with rows to lose is taken for a failed mount and refused.
    """
    features = workspace.features.read()
    root = music_dir.rstrip("/")
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    below = features if everywhere else features.where(F.col("file_path").startswith(root + "/"))
    if listing.isEmpty() and not below.isEmpty():
        raise RuntimeError(f"no files found below {music_dir}; refusing to purge the feature table")
    missing = store(C.missing_rows(below, listing).select("file_path", "file_hash"))
    if not missing.isEmpty():
        workspace.features.forget(missing)
    return missing.select("file_path").distinct()


def analyse(workspace: Workspace, files: DataFrame, extractor: Extractor, tasks: int | None = None) -> DataFrame:
    """Measures for every file: cached ones, and newly extracted ones, which are stored.

    Result columns: file_path, file_hash, measures, ``error`` (NULL when measured) and
    ``seq``, a unique order number. It is settled, so no file is extracted twice.
    """
    found = store(C.lookup(files, workspace.features.read()))
    columns = ["file_path", "file_hash", *MEASURES]
    hits = found.where("is_hit").select(*columns, F.lit(None).cast("string").alias("error"))
    misses = found.where("NOT is_hit").select(*files.columns)
    fresh = store(extract_measures(misses, extractor, tasks))
    good = fresh.where("error IS NULL")
    if not good.isEmpty():
        stored = C.coerce_measures(good.drop("error", "length"))
        workspace.features.append(stored.withColumn("last_analyzed", now()))
    everything = hits.unionByName(fresh.select(*columns, "error"))
    return store(fill_required(everything).withColumn("seq", F.monotonically_increasing_id()))


def run_full(
    spark: SparkSession,
    music_dir: str,
    host_music_dir: str,
    output_dir: str,
    cache_dir: str,
    extractor: Extractor,
    num_playlists: int = NUM_PLAYLISTS,
    tasks: int | None = None,
    layout: str = "parts",
) -> RunReport:
    """Analyse the files below ``music_dir``, cluster them and write the playlists, in parts or (``layout``) single files."""
    workspace = Workspace(spark, cache_dir)
    listing = store(list_files(spark, music_dir))
    missing = purge(workspace, listing, music_dir)
    audio = listing.where(is_audio(F.col("file_path")))
    analysed = analyse(workspace, big_enough(audio), extractor, tasks)
    good = analysed.where("error IS NULL")
    failed = C.failed_paths(missing, too_small(audio), analysed.where("error IS NOT NULL"))
    playlists = tracks = 0
    if not good.isEmpty():
        result = cluster_playlists(good, num_playlists, order="seq")
        save_playlists(result.tracks, result.summary, output_dir, music_dir, host_music_dir, layout=layout)
        playlists, tracks = result.summary.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    failures = save_failed(failed, output_dir, music_dir, host_music_dir, layout=layout)
    return RunReport(good.count(), failures, missing.count(), playlists, tracks)


def store_links(workspace: Workspace, tracks: DataFrame, summary: DataFrame, kept: DataFrame) -> None:
    """Fill the playlist and link tables from a rule grouping.

    Known names keep their id and creation time, kept links their time; every playlist is
    stamped. Playlist rows number one per playlist name; they are broadcast only up to the counted limit.
    """
    known = workspace.playlists.read()
    top = known.agg(F.max("id")).first()[0] or 0
    fresh_id = F.row_number().over(Window.orderBy("playlist_order")) + F.lit(top)
    named = summary.withColumn("fresh_id", fresh_id).join(
        known.withColumnRenamed("name", "playlist"), "playlist", "full_outer"
    )
    playlists = settle(
        named.select(
            F.coalesce("id", "fresh_id").cast("long").alias("id"),
            F.col("playlist").alias("name"),
            F.coalesce("created", now()).alias("created"),
            now().alias("last_updated"),
        )
    )
    ids = settle_small(playlists.select(F.col("id").alias("playlist_id"), F.col("name").alias("playlist")))
    links = (
        tracks.select("playlist", "file_hash")
        .join(ids, "playlist")
        .select("playlist_id", "file_hash")
        .join(kept, ["playlist_id", "file_hash"], "left")
        .withColumn("added", F.coalesce("added", now()))
    )
    # Playlists first: a crash in between leaves no link to a playlist that is not there.
    workspace.playlists.rewrite(playlists)
    workspace.links.rewrite(links)


def _regroup(workspace, music_dir, host_music_dir, output_dir, missing, rules, kept, layout) -> RunReport:
    # Several passes read these columns: they are taken out of the table once.
    columns = ["file_hash", "file_path", "bpm", "centroid", "danceability", "key", "scale", "ingest_seq"]
    result = rule_playlists(store(workspace.features.read().select(*columns)), rules, unique_hashes=True)
    tracks, summary = store(result.tracks), settle(result.summary)
    if kept is not None:
        store_links(workspace, tracks, summary, kept)
    playlists, total = summary.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if playlists:
        save_playlists(tracks, summary, output_dir, music_dir, host_music_dir, layout=layout)
    failures = save_failed(missing, output_dir, music_dir, host_music_dir, layout=layout)
    return RunReport(0, failures, missing.count(), playlists, total)


def run_from_cache(
    spark: SparkSession,
    music_dir: str,
    host_music_dir: str,
    output_dir: str,
    cache_dir: str,
    rules: GroupingRules = GroupingRules(),
    layout: str = "parts",
) -> RunReport:
    """Rule playlists out of the feature table alone."""
    workspace = Workspace(spark, cache_dir)
    missing = purge(workspace, store(list_files(spark, music_dir)), music_dir)
    return _regroup(workspace, music_dir, host_music_dir, output_dir, missing, rules, workspace.links.read(), layout)


def run_update(
    spark: SparkSession,
    music_dir: str,
    host_music_dir: str,
    output_dir: str,
    cache_dir: str,
    rules: GroupingRules = GroupingRules(),
    changed: DataFrame | None = None,
    null_watermark: str = "none",
    layout: str = "parts",
) -> RunReport:
    """Rule playlists again; links of changed files are renewed, if any file changed."""
    workspace = Workspace(spark, cache_dir)
    missing = purge(workspace, store(list_files(spark, music_dir)), music_dir)
    features = workspace.features.read()
    if changed is None:
        changed = C.changed_since(features, workspace.playlists.read(), null_watermark)
    kept = None
    if not changed.isEmpty():
        kept = store(C.unlink_changed(workspace.links.read(), features, changed))
    return _regroup(workspace, music_dir, host_music_dir, output_dir, missing, rules, kept, layout)
