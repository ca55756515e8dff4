"""Rule grouping: label, group, merge small groups, split large ones, place tracks.

A group is identified by a small integer packed from its label indexes, so group-level
tables have at most GROUP_LIMIT rows whatever the data. Such tables are moved to one
partition and broadcast; tracks are only ever hash-aggregated or cut into bounded cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import labels as L
from trackweave.functions.scalars import KEY_NAMES
from trackweave.operators.ranking import CELL_BITS, cell_of, cell_offsets, number_rows
from trackweave.session import BROADCAST_ROWS, settle, settle_small

# Below this many tracks, shuffling their paths is cheaper than one more scan.
FINGERPRINT_ROWS = 20_000_000

VARIOUS = "Various_Tracks"
VARIOUS_GID = -1
SUFFIXES = ["Warm", None, "Bright"]
KEY_SLOTS = 1 + 2 * len(KEY_NAMES)
GROUP_LIMIT = len(L.RULE_TEMPO) * len(L.RULE_ENERGY) * KEY_SLOTS * len(SUFFIXES)
SEGMENT_LIMIT = (GROUP_LIMIT + 1) * (len(L.RULE_MOOD) + 1)


@dataclass(frozen=True)
class GroupingRules:
    """Parameters of the rule grouping; the defaults are fixed values."""

    min_size: int = 20
    max_size: int = 500
    tempo_weight: float = 2.0
    energy_weight: float = 1.5
    mood_weight: float = 1.0
    accept_score: float = 2.0
    split_by: str = "group"  # or "track": split by each track's own mood
    on_collision: str = "last"  # or "union": keep all tracks of playlists sharing a name


def usable(features: DataFrame) -> DataFrame:
    """Tracks that have the three measures the labels need."""
    return features.where("bpm IS NOT NULL AND centroid IS NOT NULL AND danceability IS NOT NULL")


def label_tracks(features: DataFrame) -> DataFrame:
    """Readable labels and the composed name of every usable track."""
    tracks = usable(features).withColumns(
        {
            "bpm_group": L.bpm_group(F.col("bpm")),
            "energy_group": L.energy_group(F.col("danceability")),
            "mood_group": L.mood_group(F.col("centroid")),
            "key_group": L.key_group(F.col("key"), F.col("scale")),
        }
    )
    name = L.rule_name(F.col("bpm_group"), F.col("energy_group"), F.col("key_group"), F.col("mood_group"))
    return tracks.withColumn("playlist", name)


def code_tracks(features: DataFrame) -> DataFrame:
    """Tracks with their packed group id and mood rank; only the columns grouping needs."""
    steps = usable(features).select(
        "file_hash",
        "file_path",
        "ingest_seq",
        L.known_step(F.col("bpm"), L.RULE_TEMPO).alias("tempo"),
        L.known_step(F.col("danceability"), L.RULE_ENERGY).alias("energy"),
        L.known_step(F.col("centroid"), L.RULE_MOOD).alias("mood"),
        F.when(L.valid_key(F.col("key")), F.col("key") * 2 + F.when(F.col("scale") == 1, 1).otherwise(2))
        .otherwise(0)
        .alias("key_slot"),
    )
    suffix = F.when(F.col("mood") < 2, 0).when(F.col("mood") == 2, 1).otherwise(2)
    pair = F.col("tempo") * len(L.RULE_ENERGY) + F.col("energy")
    gid = (pair * KEY_SLOTS + F.coalesce("key_slot", F.lit(0))) * len(SUFFIXES) + suffix
    return steps.select(gid.cast("int").alias("gid"), "mood", "file_hash", "file_path", "ingest_seq")


def first_per_hash(coded: DataFrame) -> DataFrame:
    """One row per (group, hash), the first in scan order.

    A first pass counts 64-bit fingerprints of the pairs (24 bytes a row, combined before
    the shuffle). Only pairs whose fingerprint recurs are looked at themselves, and with
    none, as in a kept-up table, the tracks pass unchanged.
    """
    key = ["gid", "file_hash"]
    print_of = F.xxhash64(*key)
    recurring = settle(
        coded.groupBy(print_of.alias("print")).agg(F.count("*").alias("n")).where("n > 1").select("print")
    )
    suspects = recurring.count()
    if not suspects:
        return coded
    recurring = F.broadcast(recurring) if suspects <= BROADCAST_ROWS else recurring
    repeated = (
        coded.withColumn("print", print_of)
        .join(recurring, "print", "left_semi")
        .groupBy(*key)
        .agg(F.min("ingest_seq").alias("first_copy"))
    )
    return (
        coded.join(settle_small(repeated), key, "left")
        .where("first_copy IS NULL OR first_copy = ingest_seq")
        .drop("first_copy")
    )


def group_table(coded: DataFrame) -> DataFrame:
    """One row per group: size, first track, and the labels of the first track."""
    grouped = coded.groupBy("gid").agg(
        F.count("*").alias("size"),
        F.min("ingest_seq").alias("first_seq"),
        F.min_by("mood", "ingest_seq").alias("mood"),
    )
    return name_groups(grouped)


def name_groups(grouped: DataFrame) -> DataFrame:
    """Labels and names beside (gid, size, first_seq, mood); ``mood`` is the first track's."""
    rest = F.floor(F.col("gid") / len(SUFFIXES)).cast("int")
    key_slot = rest % KEY_SLOTS
    pair = F.floor(rest / KEY_SLOTS).cast("int")
    tempo = F.floor(pair / len(L.RULE_ENERGY)).cast("int")
    energy = pair % len(L.RULE_ENERGY)
    key_texts = [""] + [f"{k}_{m}" for k in KEY_NAMES for m in ("Major", "Minor")]
    named = grouped.select(
        "gid",
        "size",
        "first_seq",
        "mood",
        tempo.alias("tempo"),
        energy.alias("energy"),
        L.ladder_name(tempo, L.RULE_TEMPO).alias("bpm_group"),
        L.ladder_name(energy, L.RULE_ENERGY).alias("energy_group"),
        L.ladder_name(F.col("mood"), L.RULE_MOOD).alias("mood_group"),
        F.get(F.array(*[F.lit(t) for t in key_texts]), key_slot).alias("key_group"),
    )
    name = L.rule_name(F.col("bpm_group"), F.col("energy_group"), F.col("key_group"), F.col("mood_group"))
    return named.withColumn("playlist", name)


def best_matches(groups: DataFrame, rules: GroupingRules) -> DataFrame:
    """Add ``size_order`` and ``target``, the large group each small group joins (or NULL).

    A score depends only on tempo, energy and first mood of both sides, and among large
    groups alike in all three the biggest wins. So the candidates are one group per such
    triple, 125 at most; they travel as one array beside the group rows, and the best one
    is picked per row. No pairs are made and the one-partition table needs no shuffle.
    """
    by_size = [F.desc("size"), F.asc("first_seq")]
    alike = Window.partitionBy("tempo", "energy", "mood").orderBy(*by_size)
    everything = Window.partitionBy(F.lit(0))
    large = F.col("size") >= rules.min_size
    candidate = F.when(
        large & (F.col("alike_order") == 1), F.struct("tempo", "energy", "mood", "size_order", "gid")
    )

    def scored(other):
        same_tempo = F.col("tempo") == other.getField("tempo")
        same_energy = F.col("energy") == other.getField("energy")
        near_mood = F.abs(F.col("mood") - other.getField("mood")) <= 1
        score = (
            F.when(same_tempo, rules.tempo_weight).otherwise(0.0)
            + F.when(same_energy, rules.energy_weight).otherwise(0.0)
            + F.when(near_mood, rules.mood_weight).otherwise(0.0)
        )
        good = (score > 0) & (score >= rules.accept_score)
        return F.when(
            good, F.struct((-score).alias("less"), other.getField("size_order"), other.getField("gid").alias("gid"))
        )

    best = F.array_min(F.transform("candidates", scored)).getField("gid")
    return (
        groups.withColumn("size_order", F.row_number().over(Window.orderBy(*by_size)))
        .withColumn("alike_order", F.row_number().over(alike))
        .withColumn("candidates", F.collect_list(candidate).over(everything))
        .withColumn("target", F.when(~large, best))
        .drop("alike_order", "candidates")
    )


def merge_map(groups: DataFrame, rules: GroupingRules) -> DataFrame:
    """Every group with its final group, its rank there (0 = own) and the final size.

    ``size_order`` ranks groups by size before merging; Various_Tracks comes last.
    """
    own = F.col("size") >= rules.min_size
    return (
        best_matches(groups, rules)
        .withColumn("final_gid", F.when(own, F.col("gid")).otherwise(F.coalesce("target", F.lit(VARIOUS_GID))))
        .withColumn("merge_rank", F.when(own, 0).otherwise(F.col("size_order")))
        .withColumn("final_size", F.sum("size").over(Window.partitionBy("final_gid")))
        .withColumn("oversize", F.col("final_size") > rules.max_size)
        .drop("target")
    )


def one_partition(bounded: DataFrame) -> DataFrame:
    """Group-level tables (GROUP_LIMIT rows at most) on one partition: later windows and
    joins among them need no further shuffle."""
    return bounded.repartition(1)


def path_moods(coded: DataFrame, groups: DataFrame, fingerprints: bool = True) -> DataFrame:
    """Mood of the first created group holding each path, for paths held by several groups.

    Paths of one group only (nearly all) are left out: their mood is their own group's. With
    ``fingerprints`` 64-bit prints of all paths are compared first, and whole paths only
    where a print occurs in several groups: one more scan instead of shuffling every path.
    """
    held = coded.select("file_path", "gid").join(F.broadcast(groups.select("gid", "first_seq")), "gid")
    span = [F.min("first_seq").alias("first_seq"), F.max("first_seq").alias("last_seq")]
    if fingerprints:
        print_of = F.xxhash64("file_path")
        suspects = held.groupBy(print_of.alias("print")).agg(*span).where("first_seq < last_seq").select("print")
        held = held.withColumn("print", print_of).join(settle_small(suspects), "print", "left_semi")
    contested = held.groupBy("file_path").agg(*span).where("first_seq < last_seq")
    moods = groups.select("first_seq", F.col("mood").alias("path_mood"))
    return contested.join(F.broadcast(moods), "first_seq").select("file_path", "path_mood")


def split_moods(coded: DataFrame, plan: DataFrame, rules: GroupingRules) -> DataFrame:
    """Tracks with ``part``: the mood they are split by in oversize groups, -1 elsewhere."""
    info = plan.select("gid", "oversize", F.col("mood").alias("group_mood"))
    placed = coded.join(F.broadcast(info), "gid")
    any_oversize, rows = plan.agg(F.max("oversize"), F.sum("size")).first()
    if not any_oversize:
        part = F.lit(None).cast("int")
    elif rules.split_by == "track":
        part = F.col("mood")
    else:
        # Only stale paths are contested, so this side is normally small; it is counted.
        placed = placed.join(settle_small(path_moods(coded, plan, rows > FINGERPRINT_ROWS)), "file_path", "left")
        part = F.coalesce(F.col("path_mood"), F.col("group_mood"))
    return placed.select(
        "gid",
        F.when(F.col("oversize"), part).otherwise(-1).alias("part"),
        "file_hash",
        "file_path",
        "ingest_seq",
    )


def segment_table(counts: DataFrame, plan: DataFrame, rules: GroupingRules) -> DataFrame:
    """One row per (group, part): the playlist it goes to, in which place, after how many tracks.

    ``counts`` is (gid, part, n, first_part_seq). When two playlists end with one name the
    later one replaces the earlier, at the earlier one's place in the playlist order.
    """
    targets = plan.select("gid", "final_gid", "merge_rank")
    kept = plan.where("gid = final_gid").select(
        "final_gid", F.col("playlist").alias("kept_name"), F.col("size_order").alias("kept_order")
    )
    playlist = F.concat_ws(
        "_",
        F.coalesce("kept_name", F.lit(VARIOUS)),
        F.when(F.col("part") >= 0, L.ladder_name(F.col("part"), L.RULE_MOOD)),
    )
    per_playlist = Window.partitionBy("final_gid", "part")
    entries = (
        counts.join(F.broadcast(targets), "gid")
        .join(F.broadcast(kept), "final_gid", "left")
        .withColumn("playlist", playlist)
        .withColumn("kept_order", F.coalesce("kept_order", F.lit(GROUP_LIMIT + 1)))
        .withColumn("opened", F.min(F.struct("merge_rank", "first_part_seq")).over(per_playlist))
        .withColumn("written", F.struct("kept_order", "opened"))
    )
    per_name = Window.partitionBy("playlist")
    entries = entries.withColumn("listed", F.min("written").over(per_name))
    if rules.on_collision == "last":
        entries = entries.withColumn("winner", F.max("written").over(per_name)).where("written = winner")
    before = per_name.orderBy("written", "merge_rank").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.orderBy("listed")
    return (
        entries.withColumn("before_segment", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("playlist_order", F.dense_rank().over(order))
        .select("gid", "part", "playlist", "playlist_order", "before_segment", "n")
    )


@dataclass(frozen=True)
class RulePlaylists:
    """Result of the rule grouping: ``tracks`` (flat, with positions) and ``summary``."""

    tracks: DataFrame
    summary: DataFrame


def rule_playlists(features: DataFrame, rules: GroupingRules = GroupingRules(), unique_hashes: bool = False):
    """The whole rule grouping.

    ``tracks``: playlist, playlist_order, pos, file_hash, file_path. ``summary``: one row
    per playlist with order, size and group labels. ``unique_hashes`` skips the removal of
    repeated hashes when the table already has one row per hash, as the feature table has.
    """
    coded = code_tracks(features)
    if not unique_hashes:
        coded = first_per_hash(coded)
    plan = settle(merge_map(one_partition(group_table(coded)), rules))
    split = split_moods(coded, plan, rules)

    cells = settle(
        split.groupBy(*SEGMENT, cell_of("ingest_seq").alias("cell")).agg(
            F.count("*").alias("n"), F.min("ingest_seq").alias("first_part_seq")
        )
    )
    segments = settle(segments_of_cells(cells, plan, rules))
    return RulePlaylists(placed_tracks(split, cells, segments), playlist_summary(segments, plan))


SEGMENT = ["gid", "part"]


def segments_of_cells(cells: DataFrame, plan: DataFrame, rules: GroupingRules) -> DataFrame:
    """The segment table out of cell counts (gid, part, cell, n, first_part_seq)."""
    counts = cells.groupBy(*SEGMENT).agg(F.sum("n").alias("n"), F.min("first_part_seq").alias("first_part_seq"))
    return segment_table(one_partition(counts), plan, rules)


def placed_tracks(split: DataFrame, cells: DataFrame, segments: DataFrame) -> DataFrame:
    """Every track of ``split`` with its playlist and position, by its cell's place; cells and segments are settled."""
    offsets = (
        cell_offsets(cells.drop("first_part_seq"), SEGMENT)
        .join(F.broadcast(segments.drop("n")), SEGMENT)
        .withColumn("before", F.col("before") + F.col("before_segment"))
        .drop("before_segment")
    )
    if cells.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return number_rows(split, offsets, SEGMENT, "ingest_seq", "pos").select(
        "playlist", "playlist_order", "pos", "file_hash", "file_path"
    )


def playlist_summary(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per final playlist; labels are those of the group that gives the name."""
    owners = plan.where("gid = final_gid").select("final_gid", "bpm_group", "energy_group", "mood_group", "key_group")
    labels = ["bpm_group", "energy_group", "mood_group"]
    named = (
        segments.join(F.broadcast(plan.select("gid", "final_gid")), "gid")
        .groupBy("playlist", "playlist_order")
        .agg(F.sum("n").alias("size"), F.max(F.struct("final_gid", "part")).alias("owner"))
        .select("playlist", "playlist_order", "size", "owner.final_gid", "owner.part")
        .join(F.broadcast(owners), "final_gid", "left")
    )
    split_mood = L.ladder_name(F.col("part"), L.RULE_MOOD)
    return named.select(
        "playlist",
        "playlist_order",
        "size",
        (F.col("part") >= 0).alias("split"),
        *[
            F.when((F.col("part") >= 0), split_mood).otherwise(F.coalesce(c, F.lit("Various"))).alias(c)
            if c == "mood_group"
            else F.coalesce(c, F.lit("Various")).alias(c)
            for c in labels
        ],
        "key_group",
    )
