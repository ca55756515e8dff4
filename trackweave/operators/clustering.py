"""Cluster grouping: clean, scale, weight, k-means, medians, names, merge by name."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import labels as L
from trackweave.functions.scalars import at_least_zero, number_or_null, unit_interval
from trackweave.operators.medians import DIRECT_ROWS, exact_medians
from trackweave.operators.ranking import position_within
from trackweave.session import settle, store

# Clustered measures with their weights, and the default parameters.
WEIGHTS = {"bpm": 1.5, "centroid": 1.0, "danceability": 1.2}
NUM_PLAYLISTS = 8
SEED = 42
# Rounds of k-means at most, and how far centers may still move when it stops.
MAX_ITER, TOLERANCE = 100, 1e-4
# Up to this many rows Spark ML's k-means runs over all of them; larger tables take its centers on about as many rows
# as start of rounds over all rows, whose distances are columns of a plan: for up to so many centers.
START_ROWS, PLAN_CENTERS = 500_000, 16


def clean_tracks(tracks: DataFrame) -> DataFrame:
    """Rows with a path and numeric measures, clamped to their ranges.

    A measure the input lacks altogether counts as 0; a NULL or non-numeric value drops
    the row.
    """
    clamps = {"bpm": at_least_zero, "centroid": at_least_zero, "danceability": unit_interval, "duration": at_least_zero}
    types = dict(tracks.dtypes)
    numbers = {}
    for name in clamps:
        if name not in types:
            numbers[name] = F.lit(0.0)
        elif types[name] == "string":
            numbers[name] = number_or_null(F.col(name))
        else:
            numbers[name] = F.col(name).cast("double")
    kept = tracks.where("file_path IS NOT NULL").withColumns(numbers)
    for name in clamps:
        kept = kept.where(F.col(name).isNotNull())
    return kept.withColumns({name: clamp(F.col(name)) for name, clamp in clamps.items()})


def scale_weighted(tracks: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Add ``<measure>_w``: standardised by the population deviation, then weighted.

    A constant measure is only centred. The one-row statistics are read once and enter as
    constants: the tracks are not shuffled, and every later pass sees the same bits. Infinite or
    NaN measures are an error: they would turn every track's scaled measures into NaN.
    """
    parts = [x for c in weights for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_dev"))]
    stats = tracks.agg(*parts).first()
    odd = [name for name, value in stats.asDict().items() if value is not None and not math.isfinite(value)]
    if odd:
        raise ValueError(f"measures that are not finite: {', '.join(odd)}")
    return tracks.withColumns(
        {
            f"{c}_w": (F.col(c) - F.lit(stats[f"{c}_mean"])) / F.lit(stats[f"{c}_dev"] or 1.0) * F.lit(weight)
            for c, weight in weights.items()
        }
    )


def assign_nearest(points: DataFrame, centers: DataFrame, columns: list[str], out: str = "cluster") -> DataFrame:
    """Nearest center (squared distance, lowest id on ties) for each point.

    ``centers`` (id and the same columns) has one row per cluster; those few rows are read
    and become constants of one expression, so the points are not joined or shuffled.
    """
    rows = centers.select("id", *columns).collect()
    nearest = nearest_center([tuple(r)[1:] for r in rows], columns, [r["id"] for r in rows])
    return points.withColumn(out, nearest.getField("id"))


def nearest_center(centers: list[tuple[float, ...]], columns: list[str], ids: list[int] | None = None) -> Column:
    """(distance, id) of the nearest of some constant centers, squared; the lowest id (by default the place) on ties."""
    ranked = []
    for number, center in zip(ids or range(len(centers)), centers):
        offsets = [F.col(c) - F.lit(x) for c, x in zip(columns, center)]
        distance = sum((o * o for o in offsets), F.lit(0.0))
        ranked.append(F.struct(distance.alias("distance"), F.lit(number).alias("id")))
    return F.array_min(F.array(*ranked))


def place_nearest(points: DataFrame, centers: list[tuple[float, ...]], columns: list[str], out: str = "cluster") -> DataFrame:
    """Add the place of the nearest of some constant centers, the lowest on ties, as :func:`nearest_center` has it.

    Distances are plain columns, which Spark compiles into the scan; ``columns`` hold no NULL.
    """
    known = {f"_p{j}": F.coalesce(F.col(c), F.lit(0.0)) for j, c in enumerate(columns)}
    distances = {}
    for i, center in enumerate(centers):
        offsets = [F.col(p) - F.lit(x) for p, x in zip(known, center)]
        distances[f"_d{i}"] = reduce(Column.__add__, [o * o for o in offsets])
    least = F.least(*distances) if len(centers) > 1 else F.col("_d0")
    place = F.when(F.col("_d0") <= F.col("_least"), F.lit(0))
    for i in range(1, len(centers)):
        place = place.when(F.col(f"_d{i}") <= F.col("_least"), F.lit(i))
    place = place.otherwise(F.lit(len(centers) - 1))
    placed = points.withColumns(known).withColumns(distances).withColumn("_least", least).withColumn(out, place)
    return placed.drop(*known, *distances, "_least")


def lloyd(
    points: DataFrame, centers: list[tuple[float, ...]], columns: list[str], max_iter: int, tol: float
) -> tuple[list[tuple[float, ...]], bool]:
    """Centers after rounds over all points, and whether the last one moved none of them by more than ``tol``.

    A round is one scan of ``columns`` and an aggregate of a row per center; centers without points stay.
    """
    for _ in range(max_iter):
        placed = place_nearest(points.select(*columns), centers, columns)
        sums = placed.groupBy("cluster").agg(F.count("*"), *[F.sum(c) for c in columns]).collect()
        moved = list(centers)
        for at, n, *totals in sums:
            moved[at] = tuple(total / n for total in totals)
        far = max(math.dist(a, b) for a, b in zip(centers, moved))
        centers = moved
        if far <= tol:
            return centers, True
    return centers, False


@dataclass(frozen=True)
class Clustered:
    """Tracks with ``cluster``, the centers (id and weighted measures), and whether the iteration came to rest."""

    tracks: DataFrame
    centers: list[tuple[float, ...]]
    converged: bool


def kmeans_clusters(
    scaled: DataFrame,
    k: int = NUM_PLAYLISTS,
    seed: int = SEED,
    weights: dict[str, float] = WEIGHTS,
    max_iter: int = MAX_ITER,
    tol: float = TOLERANCE,
) -> Clustered:
    """K-means over the weighted measures; at most one cluster per row.

    ``converged`` is False if ``max_iter`` rounds over all rows passed without all centers moving less than ``tol``.
    Large tables get their first centers from a sample, where Spark ML's iteration ends, instead of from its first
    choice among all rows; what follows is Lloyd's iteration over all rows until the same ``tol``.
    """
    if k <= 0:
        raise ValueError(f"number of playlists must be positive, not {k}")
    rows = scaled.count()
    if rows <= 1 or k == 1:
        return Clustered(scaled.withColumn("cluster", F.lit(0)), [], True)
    columns = [f"{c}_w" for c in weights]
    features = VectorAssembler(inputCols=columns, outputCol="features")
    means = KMeans(
        k=min(k, rows), seed=seed, maxIter=max_iter, tol=tol, featuresCol="features", predictionCol="cluster"
    )

    def fitted(some: DataFrame):
        model = means.fit(features.transform(some))
        return model, [tuple(float(x) for x in center) for center in model.clusterCenters()]

    if rows > START_ROWS and k <= PLAN_CENTERS:
        start = scaled.select(*columns).sample(START_ROWS / rows, seed)
        centers = fitted(start)[1]
        # Fewer centers than asked for: the sample lacks rare points.
        if len(centers) == k:
            centers, converged = lloyd(scaled, centers, columns, max_iter, tol)
            return Clustered(place_nearest(scaled, centers, columns), centers, converged)
    model, centers = fitted(scaled)
    return Clustered(model.transform(features.transform(scaled)).drop("features"), centers, model.summary.numIter < max_iter)


def cluster_summary(clustered: DataFrame, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Per cluster: size, medians of the clustered measures and the name they give."""
    medians = exact_medians(clustered, "cluster", list(WEIGHTS), direct_rows)
    name = L.cluster_name(F.col("bpm"), F.col("centroid"), F.col("danceability"))
    return medians.withColumn("playlist", L.underscored(name))


def merge_by_name(summary: DataFrame) -> DataFrame:
    """One row per name: clusters of one name add up; their medians are folded pairwise.

    Works on one row per cluster. ``playlist_order`` follows the lowest cluster id.
    """
    entry = F.struct("cluster", *WEIGHTS)
    merged = summary.groupBy("playlist").agg(
        F.sum("size").alias("size"),
        F.min("cluster").alias("first_cluster"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )

    def folded(name: str) -> Column:
        values = F.transform("entries", lambda e: e.getField(name))
        rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1)))
        return F.aggregate(rest, F.get(values, F.lit(0)), lambda acc, m: (acc + m) / 2)

    return merged.select(
        "playlist",
        F.row_number().over(Window.orderBy("first_cluster")).alias("playlist_order"),
        "size",
        *[folded(c).alias(c) for c in WEIGHTS],
    )


def place_clustered(clustered: DataFrame, summary: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Tracks with their playlist and position: by cluster id, then by ``order``.

    ``summary`` has one row per cluster and is broadcast.
    """
    earlier = Window.partitionBy("playlist").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("playlist")
    starts = (
        summary.withColumn("before_cluster", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("first_cluster", F.min("cluster").over(first))
        .withColumn("playlist_order", F.dense_rank().over(Window.orderBy("first_cluster")))
        .select("cluster", "playlist", "playlist_order", "before_cluster")
    )
    return (
        position_within(clustered, ["cluster"], order)
        .join(F.broadcast(starts), "cluster")
        .withColumn("pos", F.col("pos") + F.col("before_cluster"))
        .drop("before_cluster")
    )


@dataclass(frozen=True)
class ClusterPlaylists:
    """Result of the cluster grouping: ``tracks`` (flat, with positions and weighted measures) and ``summary``."""

    tracks: DataFrame
    summary: DataFrame
    clustered: Clustered


def cluster_playlists(
    tracks: DataFrame,
    num_playlists: int = NUM_PLAYLISTS,
    seed: int = SEED,
    order: str = "ingest_seq",
    max_iter: int = MAX_ITER,
    tol: float = TOLERANCE,
    fit: Callable[..., Clustered] | None = None,
) -> ClusterPlaylists:
    """The whole cluster grouping; ``order`` is a unique bigint column.

    ``fit`` (scaled tracks, number, seed, ``order=``) takes the place of Lloyd's iteration: ``minibatch_clusters`` reads all
    tracks twice, to draw its samples and to assign them.

    The clean tracks are stored once, with the columns that are used. Statistics, fitting, medians, cell counts
    and positions then each scan the few columns they need; scaling and assigning again is cheaper than storing again.
    """
    used = [c for c in tracks.columns if c in {order, "file_hash", "file_path", "duration", "key", "scale", *WEIGHTS}]
    scaled = scale_weighted(store(clean_tracks(tracks.select(*used))))
    if fit:
        clustered = fit(scaled, num_playlists, seed, order=order)
    else:
        clustered = kmeans_clusters(scaled, num_playlists, seed, WEIGHTS, max_iter, tol)
    per_cluster = settle(cluster_summary(clustered.tracks))
    return ClusterPlaylists(place_clustered(clustered.tracks, per_cluster, order), merge_by_name(per_cluster), clustered)


def distribution_check(summary: DataFrame, tracks: DataFrame) -> DataFrame:
    """Whether the playlist sizes add up to the number of tracks."""
    placed = summary.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("placed"))
    total = tracks.agg(F.count("*")).scalar()
    return placed.withColumn("tracks", total).withColumn("balanced", F.col("placed") == F.col("tracks"))
