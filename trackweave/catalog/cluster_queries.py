"""Cleaning, scaling, assignment, summaries and k-means playlists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackweave.catalog.inputs import TRACKS, Query, case, table, tracks
from trackweave.functions import labels as L
from trackweave.operators import clustering as K
from trackweave.operators import minibatch as B
from trackweave.operators.medians import narrowed_medians

MEASURED = ["bpm", "centroid", "danceability"]


def clean_clamp(spark, sf_dir):
    """Measures shifted below 0 and above 1, one of them as text that is no number for some."""
    raw = tracks(spark, sf_dir).select(
        "ingest_seq",
        F.when(F.col("status") != "P", F.col("file_path")).alias("file_path"),
        (F.col("bpm") - 90).alias("bpm"),
        F.when(F.col("key") == -1, F.col("centroid").cast("string")).otherwise(F.lit("loud")).alias("centroid"),
        (F.col("danceability") * 2 - F.lit(0.5)).alias("danceability"),
    )
    return K.clean_tracks(raw).select("ingest_seq", "file_path", *MEASURED, "duration")


CLEAN_SQL = f"""{TRACKS}
SELECT ingest_seq, file_path, greatest(0e0, bpm - 90) AS bpm, centroid,
  least(1e0, greatest(0e0, danceability * 2 - 5e-1)) AS danceability, 0e0 AS duration
FROM tracks WHERE status <> 'P' AND bpm IS NOT NULL AND key = -1"""

CLEAN = f"""{TRACKS},
clean AS (SELECT * FROM tracks WHERE bpm IS NOT NULL AND centroid IS NOT NULL AND danceability IS NOT NULL),
stats AS (
  SELECT avg(bpm) AS bm, stddev_pop(bpm) AS bs, avg(centroid) AS cm, stddev_pop(centroid) AS cs,
    avg(danceability) AS dm, stddev_pop(danceability) AS ds FROM clean),
scaled AS (
  SELECT clean.*, (bpm - bm) / bs * 1.5e0 AS bpm_w, (centroid - cm) / cs AS centroid_w,
    (danceability - dm) / ds * 1.2e0 AS danceability_w FROM clean CROSS JOIN stats)"""


def _scaled(spark, sf_dir):
    return K.scale_weighted(K.clean_tracks(tracks(spark, sf_dir)))


def scale_weight(spark, sf_dir):
    return _scaled(spark, sf_dir).select("ingest_seq", *[F.round(f"{c}_w", 6).alias(f"{c}_w") for c in MEASURED])


def assign_nearest(spark, sf_dir):
    """Nearest of one center per order priority, the mean of its tracks to two digits."""
    priority = F.substring_index(F.substring_index("file_path", "/", 3), "/", -1)
    clean = K.clean_tracks(tracks(spark, sf_dir))
    centers = clean.groupBy(F.substring(priority, 1, 1).cast("int").alias("id")).agg(
        *[F.round(F.avg(c), 2).alias(c) for c in MEASURED]
    )
    return K.assign_nearest(clean, centers, MEASURED).select("ingest_seq", "cluster")


ASSIGN_SQL = f"""{CLEAN},
centers AS (
  SELECT CAST(substr(split_part(file_path, '/', 3), 1, 1) AS INT) AS id, round(avg(bpm), 2) AS x,
    round(avg(centroid), 2) AS y, round(avg(danceability), 2) AS z FROM clean GROUP BY 1)
SELECT ingest_seq, arg_min(id, (d, id)) AS cluster FROM (
  SELECT ingest_seq, id, (bpm - x) * (bpm - x) + (centroid - y) * (centroid - y)
    + (danceability - z) * (danceability - z) AS d FROM clean CROSS JOIN centers)
GROUP BY ingest_seq"""


def _pseudo(spark, sf_dir):
    """Tracks with a repeatable cluster number, one of them holding most tracks."""
    number = F.expr("CASE WHEN ingest_seq % 16 < 9 THEN 7 ELSE CAST(ingest_seq % 16 - 9 AS INT) END")
    return K.clean_tracks(tracks(spark, sf_dir)).withColumn("cluster", number)


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def cluster_summary(spark, sf_dir):
    return _rounded(K.cluster_summary(_pseudo(spark, sf_dir)), MEASURED).select(
        "cluster", "size", *MEASURED, "playlist"
    )


def cluster_medians_narrowed(spark, sf_dir):
    """The same medians by bracketing, as for clusters too large for one task."""
    found = narrowed_medians(_pseudo(spark, sf_dir), "cluster", MEASURED, direct_rows=100)
    return found.select("cluster", "measure", F.round("median", 6).alias("median"))


def cluster_merge_names(spark, sf_dir):
    merged = K.merge_by_name(K.cluster_summary(_pseudo(spark, sf_dir)))
    return _rounded(merged, MEASURED).select(
        "playlist",
        F.col("playlist_order").cast("long").alias("playlist_order"),
        F.col("size").cast("long").alias("size"),
        *MEASURED,
    )


def cluster_positions(spark, sf_dir):
    pseudo = _pseudo(spark, sf_dir)
    placed = K.place_clustered(pseudo, K.cluster_summary(pseudo))
    return placed.select(
        "playlist", F.col("playlist_order").cast("long").alias("playlist_order"), "pos", "file_path", "ingest_seq"
    )


_NAME = " || '_' || ".join(
    [
        case("bpm", [(70, "Slow"), (100, "Medium"), (130, "Upbeat"), (None, "Fast")]),
        case("danceability", [(0.3, "Chill"), (0.5, "Easy"), (0.7, "Groovy"), (0.85, "Dance"), (None, "Energetic")]),
        case(
            "centroid", [(300, "Relaxing"), (1000, "Mellow"), (2000, "Balanced"), (4000, "Bright"), (None, "Intense")]
        ),
    ]
)

PSEUDO = f"""{CLEAN},
pseudo AS (
  SELECT *, CASE WHEN ingest_seq % 16 < 9 THEN 7 ELSE CAST(ingest_seq % 16 - 9 AS INT) END AS cluster FROM clean),
medians AS (
  SELECT cluster, count(*) AS size, median(bpm) AS bpm, median(centroid) AS centroid,
    median(danceability) AS danceability FROM pseudo GROUP BY cluster),
summary AS (SELECT *, {_NAME} AS playlist FROM medians)"""

MERGE_SQL = f"""{PSEUDO},
lists AS (
  SELECT playlist, CAST(sum(size) AS BIGINT) AS size, min(cluster) AS first_cluster,
    list(bpm ORDER BY cluster) AS b, list(centroid ORDER BY cluster) AS c, list(danceability ORDER BY cluster) AS d
  FROM summary GROUP BY playlist)
SELECT playlist, row_number() OVER (ORDER BY first_cluster) AS playlist_order, size,
  round(list_reduce(b, lambda acc, m: (acc + m) / 2), 6) AS bpm,
  round(list_reduce(c, lambda acc, m: (acc + m) / 2), 6) AS centroid,
  round(list_reduce(d, lambda acc, m: (acc + m) / 2), 6) AS danceability FROM lists"""

POSITIONS_SQL = f"""{PSEUDO},
named AS (
  SELECT p.*, s.playlist, min(p.cluster) OVER (PARTITION BY s.playlist) AS first_cluster
  FROM pseudo p JOIN summary s ON p.cluster = s.cluster)
SELECT playlist, dense_rank() OVER (ORDER BY first_cluster) AS playlist_order,
  row_number() OVER (PARTITION BY playlist ORDER BY cluster, ingest_seq) AS pos, file_path, ingest_seq FROM named"""


def _names_by_steps(points):
    """(cluster, cluster_name) from counts on the steps of the names' ladders, without the operator's medians.

    Both middle rows on one step: any value of it gives the median's word. Else they are the last value of
    the lower and the first of the upper step. What is kept has a row for each cluster and steps.
    """
    ladders = {"bpm": L.CLUSTER_TEMPO, "centroid": L.CLUSTER_TIMBRE, "danceability": L.CLUSTER_DANCE}
    ends = [end(c).alias(f"{c}_{end.__name__}") for c in ladders for end in (F.min, F.max)]
    steps = [L.step_index(F.col(c), ladder).alias(f"{c}_step") for c, ladder in ladders.items()]
    counted = points.groupBy("cluster", *steps).agg(F.count("*").alias("n"), *ends)
    entry = [
        F.struct(F.lit(c).alias("measure"), *[F.col(f"{c}_{x}").alias(x) for x in ("step", "min", "max")]) for c in ladders
    ]
    each = counted.select("cluster", "n", F.inline(F.array(*entry))).groupBy("cluster", "measure", "step")
    each = each.agg(F.sum("n").alias("n"), F.min("min").alias("first"), F.max("max").alias("last"))
    group = Window.partitionBy("cluster", "measure")
    before = F.coalesce(F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.select("*", before.alias("before"), F.sum("n").over(group).alias("total"))
    ranks = [F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)]
    lower, upper = [(F.col("before") <= r) & (r < F.col("before") + F.col("n")) for r in ranks]
    middle = F.when(lower & upper, F.col("first")).when(lower, F.col("last") / 2).when(upper, F.col("first") / 2)
    found = placed.groupBy("cluster").agg(*[F.sum(F.when(F.col("measure") == c, middle)).alias(c) for c in ladders])
    return found.select("cluster", L.underscored(L.cluster_name(*[F.col(c) for c in ladders])).alias("cluster_name"))


def kmeans_playlists(spark, sf_dir):
    """Per track: whether no center is nearer than its cluster's, and whether its playlist has its cluster's name."""
    result = K.cluster_playlists(tracks(spark, sf_dir))
    weighted = [f"{c}_w" for c in MEASURED]

    def distance(center):
        return sum(((F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(weighted, center)), F.lit(0.0))

    distances = [distance(center) for center in result.clustered.centers]
    own = F.coalesce(*[F.when(F.col("cluster") == i, d) for i, d in enumerate(distances)])
    named = F.broadcast(_names_by_steps(result.clustered.tracks))
    return result.tracks.join(named, "cluster").select(
        "file_hash",
        (own <= F.least(*distances) + F.lit(1e-9)).alias("nearest"),
        (F.col("playlist") == F.col("cluster_name")).alias("named"),
    )


def kmeans_distribution(spark, sf_dir):
    """Every clean track lies in exactly one k-means playlist."""
    clean = K.clean_tracks(tracks(spark, sf_dir))
    return K.distribution_check(K.cluster_playlists(tracks(spark, sf_dir)).summary, clean)


# Mini-batches with fixed start centers and keys that both engines can compute.
START = [(-1.5, -0.5, -1.0), (-0.5, 0.5, 1.0), (0.5, -0.5, 0.5), (1.5, 0.5, -0.5)]
ROUNDS, BATCH, KEYS = 4, 150, B.KEYS
MIXER, STEP = 1_103_515_245, 12_345


def _minibatch(spark, sf_dir) -> K.Clustered:
    def key(epoch):
        return (F.col("ingest_seq") % KEYS * MIXER + STEP * (epoch + 1)) % KEYS

    how = B.MiniBatch(rounds=ROUNDS, batch=BATCH, patience=0)
    return B.minibatch_clusters(_scaled(spark, sf_dir), len(START), how=how, start=START, key=key)


def minibatch_centers(spark, sf_dir):
    """Centers after a few rounds, with the number of tracks that are nearest to each."""
    found = _minibatch(spark, sf_dir)
    rows = [(i, *c) for i, c in enumerate(found.centers)]
    centers = spark.createDataFrame(rows, "cluster int, bpm_w double, centroid_w double, danceability_w double")
    sizes = found.tracks.groupBy("cluster").agg(F.count("*").alias("size"))
    return centers.join(sizes, "cluster", "left").select(
        "cluster", F.coalesce("size", F.lit(0)).alias("size"), *[F.round(f"{c}_w", 6).alias(f"{c}_w") for c in MEASURED]
    )


def minibatch_assigned(spark, sf_dir):
    """Every clean track with the nearest of these centers."""
    return _minibatch(spark, sf_dir).tracks.select("ingest_seq", "cluster")


def _minibatch_sql() -> str:
    values = ", ".join(f"({i}, {x}e0, {y}e0, {z}e0, 0)" for i, (x, y, z) in enumerate(START))
    parts = [
        f"""{CLEAN}, keyed AS (SELECT *, CAST(row_number() OVER (ORDER BY (ingest_seq % {KEYS} * {MIXER} + {STEP}) % {KEYS},
          ingest_seq) - 1 AS BIGINT) // {BATCH} AS round FROM scaled),
        c0(id, x, y, z, v) AS (VALUES {values})"""
    ]
    distance = "(bpm_w - x) * (bpm_w - x) + (centroid_w - y) * (centroid_w - y) + (danceability_w - z) * (danceability_w - z)"
    for r in range(ROUNDS):
        parts.append(
            f"""n{r} AS (SELECT ingest_seq, arg_min(id, (d, id)) AS id FROM (
              SELECT ingest_seq, id, {distance} AS d FROM keyed CROSS JOIN c{r} WHERE round = {r}) GROUP BY ingest_seq),
            s{r} AS (SELECT id, count(*) AS m, sum(bpm_w) AS sx, sum(centroid_w) AS sy, sum(danceability_w) AS sz
              FROM n{r} JOIN keyed USING (ingest_seq) GROUP BY id),
            c{r + 1} AS (SELECT c.id, {", ".join(
                f"CASE WHEN m IS NULL THEN {a} ELSE {a} + (s{a} - m * {a}) / (v + m) END AS {a}" for a in "xyz"
            )}, v + coalesce(m, 0) AS v FROM c{r} c LEFT JOIN s{r} ON c.id = s{r}.id)"""
        )
    parts.append(
        f"""assigned AS (SELECT ingest_seq, CAST(arg_min(id, (d, id)) AS INT) AS cluster FROM (
          SELECT ingest_seq, id, {distance} AS d FROM scaled CROSS JOIN c{ROUNDS}) GROUP BY ingest_seq)"""
    )
    return ", ".join(parts)


QUERIES = {
    "clean_clamp": Query(clean_clamp, CLEAN_SQL),
    "scale_weight": Query(
        scale_weight,
        f"""{CLEAN} SELECT ingest_seq, round(bpm_w, 6) AS bpm_w, round(centroid_w, 6) AS centroid_w,
        round(danceability_w, 6) AS danceability_w FROM scaled""",
    ),
    "assign_nearest": Query(assign_nearest, ASSIGN_SQL),
    "cluster_summary": Query(
        cluster_summary,
        f"""{PSEUDO} SELECT cluster, size, round(bpm, 6) AS bpm, round(centroid, 6) AS centroid,
        round(danceability, 6) AS danceability, playlist FROM summary""",
    ),
    "cluster_medians_narrowed": Query(
        cluster_medians_narrowed,
        f"""{PSEUDO} SELECT cluster, 'bpm' AS measure, round(bpm, 6) AS median FROM medians
        UNION ALL SELECT cluster, 'centroid', round(centroid, 6) FROM medians
        UNION ALL SELECT cluster, 'danceability', round(danceability, 6) FROM medians""",
    ),
    "cluster_merge_names": Query(cluster_merge_names, MERGE_SQL),
    "cluster_positions": Query(cluster_positions, POSITIONS_SQL),
    "kmeans_playlists": Query(
        kmeans_playlists, f"{CLEAN} SELECT file_hash, true AS nearest, true AS named FROM clean"
    ),
    "minibatch_centers": Query(
        minibatch_centers,
        f"""{_minibatch_sql()} SELECT CAST(c.id AS INT) AS cluster, count(a.cluster) AS size, round(any_value(x), 6) AS bpm_w,
          round(any_value(y), 6) AS centroid_w, round(any_value(z), 6) AS danceability_w
        FROM c{ROUNDS} c LEFT JOIN assigned a ON a.cluster = c.id GROUP BY c.id""",
    ),
    "minibatch_assigned": Query(minibatch_assigned, f"{_minibatch_sql()} SELECT ingest_seq, cluster FROM assigned"),
    "kmeans_distribution": Query(
        kmeans_distribution,
        f"{CLEAN} SELECT count(*) AS placed, count(*) AS tracks, true AS balanced FROM clean",
    ),
}
