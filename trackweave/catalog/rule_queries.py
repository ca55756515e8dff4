"""Labels and rule grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.catalog.cache_queries import scratch
from trackweave.catalog.inputs import TRACKS, Query, case, table, tracks
from trackweave.functions import labels as L
from trackweave.operators import grouping as G
from trackweave.operators.incremental import GroupedTracks
from trackweave.session import settle

# The label ladders and key names, written from the published cut-offs.
BPM = case("bpm", [(70, "Slow"), (100, "Medium"), (130, "Upbeat"), (160, "Fast"), (None, "VeryFast")])
ENERGY = case(
    "danceability", [(0.3, "Chill"), (0.5, "Mellow"), (0.7, "Groovy"), (0.85, "Energetic"), (None, "Intense")]
)
MOOD = case("centroid", [(500, "Warm"), (1500, "Mellow"), (3000, "Balanced"), (6000, "Bright"), (None, "Crisp")])
KEY = (
    "CASE WHEN key BETWEEN 0 AND 11 THEN "
    "list_extract(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], key + 1) "
    "|| CASE WHEN scale = 1 THEN '_Major' ELSE '_Minor' END ELSE '' END"
)

LABELLED = f"""{TRACKS},
marked AS (
  SELECT *, {BPM} AS bpm_group, {ENERGY} AS energy_group, {MOOD} AS mood_group, {KEY} AS key_group
  FROM tracks WHERE bpm IS NOT NULL AND centroid IS NOT NULL AND danceability IS NOT NULL),
labelled AS (
  SELECT *, bpm_group || '_' || energy_group
    || CASE WHEN key_group <> '' THEN '_' || key_group ELSE '' END
    || CASE WHEN mood_group IN ('Bright', 'Crisp') THEN '_Bright'
            WHEN mood_group IN ('Warm', 'Mellow') THEN '_Warm' ELSE '' END AS playlist
  FROM marked)"""

GROUPS = f"""{LABELLED},
groups AS (
  SELECT playlist, count(DISTINCT file_hash) AS size, min(ingest_seq) AS first_seq,
    arg_min(mood_group, ingest_seq) AS mood_group, min(bpm_group) AS bpm_group,
    min(energy_group) AS energy_group, min(key_group) AS key_group,
    list_position(['Warm', 'Mellow', 'Balanced', 'Bright', 'Crisp'], arg_min(mood_group, ingest_seq)) AS mood_rank
  FROM labelled GROUP BY playlist)"""

MERGED = f"""{GROUPS},
ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, first_seq) AS size_order FROM groups),
scored AS (
  SELECT s.playlist, l.playlist AS target, l.size_order,
    CASE WHEN s.bpm_group = l.bpm_group THEN 2e0 ELSE 0e0 END
    + CASE WHEN s.energy_group = l.energy_group THEN 1.5e0 ELSE 0e0 END
    + CASE WHEN abs(s.mood_rank - l.mood_rank) <= 1 THEN 1e0 ELSE 0e0 END AS score
  FROM ranked s JOIN ranked l ON s.size < 20 AND l.size >= 20),
best AS (
  SELECT playlist, target, score FROM (
    SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY score DESC, size_order) AS rn FROM scored)
  WHERE rn = 1 AND score >= 2),
merged AS (
  SELECT r.*, CASE WHEN r.size >= 20 THEN r.playlist ELSE coalesce(b.target, 'Various_Tracks') END AS final_name,
    CASE WHEN r.size >= 20 THEN 0 ELSE r.size_order END AS merge_rank
  FROM ranked r LEFT JOIN best b ON r.playlist = b.playlist),
finals AS (
  SELECT *, sum(size) OVER (PARTITION BY final_name) AS final_size FROM merged)"""

PLACED = f"""{MERGED},
path_mood AS (
  SELECT l.file_path, arg_min(g.mood_group, g.first_seq) AS path_mood
  FROM labelled l JOIN groups g ON l.playlist = g.playlist GROUP BY l.file_path),
assigned AS (
  SELECT l.file_hash, l.file_path, l.ingest_seq, f.final_name, f.merge_rank,
    CASE WHEN f.final_size > 500 THEN p.path_mood END AS part,
    coalesce(k.size_order, 1000000) AS kept_order
  FROM labelled l JOIN finals f ON l.playlist = f.playlist
  JOIN path_mood p ON l.file_path = p.file_path
  LEFT JOIN ranked k ON k.playlist = f.final_name),
placed AS (
  SELECT final_name || CASE WHEN part IS NULL THEN '' ELSE '_' || part END AS playlist, final_name, part,
    file_hash, file_path, kept_order,
    row_number() OVER (PARTITION BY final_name, part ORDER BY merge_rank, ingest_seq) AS pos,
    first_value(merge_rank) OVER (PARTITION BY final_name, part ORDER BY merge_rank, ingest_seq) AS open_rank,
    first_value(ingest_seq) OVER (PARTITION BY final_name, part ORDER BY merge_rank, ingest_seq) AS open_seq
  FROM assigned),
ordered AS (
  SELECT playlist, dense_rank() OVER (ORDER BY kept_order, open_rank, open_seq) AS playlist_order,
    pos, file_hash, file_path FROM placed)"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_per_hash(G.code_tracks(tracks(spark, sf_dir)))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.one_partition(G.group_table(_coded(spark, sf_dir)))


def label_rule(spark, sf_dir):
    return tracks(spark, sf_dir).select(
        "ingest_seq",
        L.bpm_group(F.col("bpm")).alias("bpm_group"),
        L.energy_group(F.col("danceability")).alias("energy_group"),
        L.mood_group(F.col("centroid")).alias("mood_group"),
        L.mood_rank(F.col("centroid")).alias("mood_rank"),
        L.key_group(F.col("key"), F.col("scale")).alias("key_group"),
    )


def label_cluster(spark, sf_dir):
    name = L.cluster_name(F.col("bpm"), F.col("centroid"), F.col("danceability"))
    return tracks(spark, sf_dir).select("ingest_seq", name.alias("name"), L.underscored(name).alias("file_name"))


CLUSTER_WORDS = " || ' ' || ".join(
    [
        case("b", [(70, "Slow"), (100, "Medium"), (130, "Upbeat"), (None, "Fast")]),
        case("d", [(0.3, "Chill"), (0.5, "Easy"), (0.7, "Groovy"), (0.85, "Dance"), (None, "Energetic")]),
        case("c", [(300, "Relaxing"), (1000, "Mellow"), (2000, "Balanced"), (4000, "Bright"), (None, "Intense")]),
    ]
)

LABEL_CLUSTER_SQL = f"""{TRACKS},
safe AS (
  SELECT ingest_seq,
    CASE WHEN bpm IS NULL OR centroid IS NULL OR danceability IS NULL THEN 0e0 ELSE bpm END AS b,
    CASE WHEN bpm IS NULL OR centroid IS NULL OR danceability IS NULL THEN 0e0 ELSE centroid END AS c,
    CASE WHEN bpm IS NULL OR centroid IS NULL OR danceability IS NULL THEN 0e0 ELSE danceability END AS d
  FROM tracks),
named AS (SELECT ingest_seq, {CLUSTER_WORDS} AS name FROM safe)
SELECT ingest_seq, name, replace(name, ' ', '_') AS file_name FROM named"""


def label_documented(spark, sf_dir):
    tempo = L.documented_tempo(F.col("bpm"))
    timbre = L.documented_timbre(F.col("centroid"))
    return tracks(spark, sf_dir).select(
        "ingest_seq",
        tempo.alias("tempo"),
        timbre.alias("timbre"),
        L.documented_duration(F.col("duration")).alias("length"),
        L.energy_level(F.col("beat_confidence")).alias("energy"),
        L.documented_mood(tempo, timbre, L.energy_number(F.col("beat_confidence"))).alias("mood"),
        L.documented_name(F.col("bpm"), F.col("centroid"), F.col("duration"), F.col("beat_confidence")).alias("name"),
    )


# The documented ladders.
_DOC_TEMPO = case(
    "bpm",
    [
        (55, "VerySlow"),
        (70, "Slow"),
        (85, "Chill"),
        (100, "Medium"),
        (115, "Upbeat"),
        (135, "Energetic"),
        (155, "Fast"),
        (None, "VeryFast"),
    ],
)
_DOC_TIMBRE = case(
    "centroid",
    [(800, "Dark"), (1500, "Warm"), (2200, "Mellow"), (3000, "Bright"), (4000, "Sharp"), (None, "VerySharp")],
)
_DOC_LENGTH = case("duration", [(60, "Brief"), (120, "Short"), (180, "Medium"), (240, "Long"), (None, "VeryLong")])

LABEL_DOCUMENTED_SQL = f"""{TRACKS},
d AS (
  SELECT ingest_seq, {_DOC_TEMPO} AS tempo, {_DOC_TIMBRE} AS timbre, {_DOC_LENGTH} AS length,
    CAST(floor(greatest(0e0, least(1e0, beat_confidence)) * 10) AS INT) AS level
  FROM tracks),
m AS (
  SELECT *, CASE WHEN tempo = 'VerySlow' AND timbre = 'Dark' THEN 'Ambient'
    WHEN tempo IN ('VerySlow', 'Slow', 'Chill') AND level <= 3 THEN 'Downtempo'
    WHEN tempo IN ('Energetic', 'Fast', 'VeryFast') AND level >= 7 THEN 'Dance'
    WHEN timbre IN ('Bright', 'Sharp', 'VerySharp') AND level >= 7 THEN 'Dynamic'
    ELSE 'Balanced' END AS mood FROM d)
SELECT ingest_seq, tempo, timbre, length, 'E' || level AS energy, mood,
  tempo || '_' || timbre || '_' || length || '_E' || level || '_' || mood AS name FROM m"""


def playlist_name_rule(spark, sf_dir):
    return G.label_tracks(tracks(spark, sf_dir)).select("ingest_seq", "file_hash", "key_group", "playlist")


def group_tracks(spark, sf_dir):
    return _groups(spark, sf_dir).select(
        "playlist", "size", "first_seq", "bpm_group", "energy_group", "mood_group", "key_group"
    )


# The same tracks with hashes that recur, within a group too.
_ONE, _MANY = "CAST(o_orderkey AS STRING) AS file_hash", "CAST(o_orderkey % 701 AS STRING) AS file_hash"
GROUPS_REPEATED = GROUPS.replace(_ONE, _MANY)


def _repeated(spark, sf_dir) -> DataFrame:
    return tracks(spark, sf_dir).withColumn("file_hash", (F.col("ingest_seq") % 701).cast("string"))


def first_per_hash(spark, sf_dir):
    """Which track stands for a hash that recurs in a group."""
    coded = settle(G.first_per_hash(G.code_tracks(_repeated(spark, sf_dir))))
    names = settle(G.one_partition(G.group_table(coded))).select("gid", "playlist")
    return coded.join(F.broadcast(names), "gid").select("playlist", "file_hash", "ingest_seq")


def groups_repeated_hashes(spark, sf_dir):
    groups = G.group_table(G.first_per_hash(G.code_tracks(_repeated(spark, sf_dir))))
    return groups.select("playlist", "size", "first_seq", "mood_group")


# Seven of ten tracks are Balanced, three are Warm, and every tenth path is held by both: split by the path's
# mood, the large group gives a part the name of the small one.
COLLIDING = """
SELECT o_orderkey AS ingest_seq, CAST(o_orderkey AS STRING) AS file_hash,
  '/m/' || CASE WHEN o_orderkey % 10 IN (2, 3) THEN 'x' || (o_orderkey - o_orderkey % 10) ELSE '' || o_orderkey END AS file_path,
  6e1 AS bpm, 1e-1 AS danceability, CASE WHEN o_orderkey % 10 < 3 THEN 1e2 ELSE 2e3 END AS centroid,
  -1 AS key, 0 AS scale
FROM {orders}
"""


def name_collisions(spark, sf_dir):
    """Playlists of one name under both policies: the later one alone, or all their tracks."""
    rows = spark.sql(COLLIDING, orders=table(spark, sf_dir, "orders"))
    half = rows.count() // 2
    out = []
    for policy in ("last", "union"):
        rules = G.GroupingRules(max_size=half, on_collision=policy)
        placed = G.rule_playlists(rows, rules, unique_hashes=True).tracks
        out.append(placed.select(F.lit(policy).alias("policy"), "playlist", "pos", "file_hash"))
    return out[0].unionByName(out[1])


NAME_COLLISIONS_SQL = """
WITH t AS (
  SELECT o_orderkey AS seq, o_orderkey % 10 < 3 AS small, o_orderkey % 10 <= 3 AS warm, p.policy FROM orders,
    (VALUES ('last'), ('union')) p(policy)
  WHERE p.policy = 'union' OR o_orderkey % 10 <> 3)
SELECT policy, CASE WHEN warm THEN 'Slow_Chill_Warm' ELSE 'Slow_Chill_Balanced' END AS playlist,
  row_number() OVER (PARTITION BY policy, warm ORDER BY small, seq) AS pos, CAST(seq AS VARCHAR) AS file_hash FROM t"""


def group_sizes_ranked(spark, sf_dir):
    plan = G.merge_map(_groups(spark, sf_dir), G.GroupingRules())
    return plan.select("playlist", "size", F.col("size_order").cast("long").alias("size_order"))


def merge_small(spark, sf_dir):
    plan = settle(G.merge_map(_groups(spark, sf_dir), G.GroupingRules()))
    finals = plan.where("gid = final_gid").select("final_gid", F.col("playlist").alias("final_name"))
    return plan.join(finals, "final_gid", "left").select(
        "playlist",
        "size",
        F.coalesce("final_name", F.lit(G.VARIOUS)).alias("final_name"),
        F.col("merge_rank").cast("long").alias("merge_rank"),
        F.col("final_size").cast("long").alias("final_size"),
    )


def split_large(spark, sf_dir):
    """Split parts of the playlists that grew beyond the limit."""
    return (
        G.rule_playlists(tracks(spark, sf_dir), unique_hashes=True)
        .summary.where("split")
        .select("playlist", F.col("size").cast("long").alias("size"), "mood_group")
    )


def playlists_final(spark, sf_dir):
    result = G.rule_playlists(tracks(spark, sf_dir), unique_hashes=True).summary
    return result.select(
        "playlist",
        F.col("playlist_order").cast("long").alias("playlist_order"),
        F.col("size").cast("long").alias("size"),
        "bpm_group",
        "energy_group",
        "mood_group",
        "key_group",
    )


def playlist_positions(spark, sf_dir):
    result = G.rule_playlists(tracks(spark, sf_dir)).tracks
    return result.select(
        "playlist",
        F.col("playlist_order").cast("long").alias("playlist_order"),
        "pos",
        "file_hash",
        "file_path",
    )


def split_path_mood(spark, sf_dir):
    """Paths held by several groups, with the mood they are split by."""
    coded = _coded(spark, sf_dir)
    moods = G.path_moods(coded, settle(_groups(spark, sf_dir)))
    return moods.select("file_path", L.ladder_name(F.col("path_mood"), L.RULE_MOOD).alias("path_mood"))


SUMMARY_SQL = f"""{PLACED},
labels AS (
  SELECT p.playlist, p.final_name, p.part, count(*) AS size
  FROM placed p GROUP BY p.playlist, p.final_name, p.part),
orders_of AS (SELECT DISTINCT playlist, playlist_order FROM ordered)
SELECT l.playlist, o.playlist_order, l.size, coalesce(r.bpm_group, 'Various') AS bpm_group,
  coalesce(r.energy_group, 'Various') AS energy_group,
  coalesce(l.part, r.mood_group, 'Various') AS mood_group, r.key_group
FROM labels l JOIN orders_of o ON l.playlist = o.playlist LEFT JOIN ranked r ON r.playlist = l.final_name"""

# Tracks after two change sets: files that replace another one, tracks that come later, tracks that go.
AFTER_CHANGES = """(ingest_seq % 50 = 7
  OR (ingest_seq % 50 = 6 AND status <> 'P'
      AND NOT EXISTS (SELECT 1 FROM tracks o WHERE o.ingest_seq = tracks.ingest_seq + 1 AND o.file_path = tracks.file_path))
  OR (ingest_seq % 50 NOT IN (6, 7) AND (status = 'P' OR (owner % 19 <> 3 AND owner % 23 <> 5))))"""


def _after_changes(spark, sf_dir) -> GroupedTracks:
    """Two change sets on top of a first state, in small partitions."""
    t = tracks(spark, sf_dir)
    plain = t.where("ingest_seq % 50 NOT IN (6, 7)")
    state = GroupedTracks(spark, scratch(spark), slice_bits=15, buckets=8)
    state.rebuild(t.where("ingest_seq % 50 <> 7 AND status <> 'P'"))
    state.update(t.where("ingest_seq % 50 = 7"), plain.where("owner % 19 = 3"))
    state.update(plain.where("status = 'P'"), plain.where("owner % 23 = 5 AND status <> 'P'"))
    return state


def update_by_changes(spark, sf_dir):
    """Playlists and positions kept up to date by change sets, in the end as if made anew."""
    found = _after_changes(spark, sf_dir).playlists().tracks
    return found.withColumn("playlist_order", F.col("playlist_order").cast("bigint"))


def update_links(spark, sf_dir):
    """The playlist of every track after the change sets, without ordering anything."""
    return _after_changes(spark, sf_dir).links()


AFTER_SQL = PLACED.replace("FROM tracks WHERE bpm IS NOT NULL", f"FROM tracks WHERE {AFTER_CHANGES} AND bpm IS NOT NULL")

QUERIES = {
    "label_rule": Query(
        label_rule,
        f"""{TRACKS} SELECT ingest_seq, {BPM} AS bpm_group, {ENERGY} AS energy_group, {MOOD} AS mood_group,
        CAST(list_position(['Warm', 'Mellow', 'Balanced', 'Bright', 'Crisp'], {MOOD}) - 1 AS INT) AS mood_rank,
        {KEY} AS key_group FROM tracks""",
    ),
    "label_cluster": Query(label_cluster, LABEL_CLUSTER_SQL),
    "label_documented": Query(label_documented, LABEL_DOCUMENTED_SQL),
    "playlist_name_rule": Query(
        playlist_name_rule, f"{LABELLED} SELECT ingest_seq, file_hash, key_group, playlist FROM labelled"
    ),
    "group_tracks": Query(
        group_tracks,
        f"{GROUPS} SELECT playlist, size, first_seq, bpm_group, energy_group, mood_group, key_group FROM groups",
    ),
    "first_per_hash": Query(
        first_per_hash,
        f"""{GROUPS_REPEATED} SELECT playlist, file_hash, min(ingest_seq) AS ingest_seq FROM labelled
        GROUP BY playlist, file_hash""",
    ),
    "groups_repeated_hashes": Query(
        groups_repeated_hashes, f"{GROUPS_REPEATED} SELECT playlist, size, first_seq, mood_group FROM groups"
    ),
    "name_collisions": Query(name_collisions, NAME_COLLISIONS_SQL),
    "group_sizes_ranked": Query(group_sizes_ranked, f"{MERGED} SELECT playlist, size, size_order FROM ranked"),
    "merge_small": Query(
        merge_small,
        f"""{MERGED} SELECT playlist, size, final_name, CAST(merge_rank AS BIGINT) AS merge_rank,
        CAST(final_size AS BIGINT) AS final_size FROM finals""",
    ),
    "split_path_mood": Query(
        split_path_mood,
        f"""{PLACED} SELECT p.file_path, p.path_mood FROM path_mood p
        WHERE (SELECT count(DISTINCT l.playlist) FROM labelled l WHERE l.file_path = p.file_path) > 1""",
    ),
    "split_large": Query(
        split_large,
        f"""{PLACED} SELECT playlist, count(*) AS size, part AS mood_group FROM placed
        WHERE part IS NOT NULL GROUP BY playlist, part""",
    ),
    "playlists_final": Query(playlists_final, SUMMARY_SQL),
    "update_by_changes": Query(
        update_by_changes, f"{AFTER_SQL} SELECT playlist, playlist_order, pos, file_hash, file_path FROM ordered"
    ),
    "update_links": Query(update_links, f"{AFTER_SQL} SELECT playlist, file_hash FROM ordered"),
    "playlist_positions": Query(
        playlist_positions, f"{PLACED} SELECT playlist, playlist_order, pos, file_hash, file_path FROM ordered"
    ),
}
