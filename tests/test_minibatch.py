"""Mini-batch k-means against plain numpy, and its inertia against Lloyd's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import clustering as K
from trackweave.operators import minibatch as B

COLUMNS = ["bpm_w", "centroid_w", "danceability_w"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(41)
    middles = rng.normal(size=(5, 3)) * 6
    rows = [(i, *map(float, middles[i % 5] + rng.normal(size=3))) for i in range(3000)]
    df = spark.createDataFrame(rows, "ingest_seq bigint, bpm_w double, centroid_w double, danceability_w double")
    path = df.sparkSession.sparkContext.getCheckpointDir()
    return df.repartition(5).checkpoint() if path else df


def inertia(found):
    rows = found.tracks.select("cluster", *COLUMNS).collect()
    return sum(sum((r[c] - x) ** 2 for c, x in zip(COLUMNS, found.centers[r.cluster])) for r in rows)


def test_rounds_equal_plain_updates(spark, points):
    how = B.MiniBatch(rounds=7, batch=1000, patience=0)  # three rounds an epoch
    start = [(0.0, 0.0, 0.0), (5.0, 5.0, 5.0), (-5.0, 0.0, 5.0)]
    key = lambda epoch: (F.col("ingest_seq") * 7919 + 31 * (epoch + 1)) % B.KEYS
    found = B.minibatch_clusters(points, 3, how=how, start=start, key=key)
    data = {r.ingest_seq: np.array([r[c] for c in COLUMNS]) for r in points.collect()}
    centers, seen = [np.array(c) for c in start], [0] * 3
    for number in range(7):
        epoch, place = divmod(number, 3)
        order = sorted(data, key=lambda s: ((s * 7919 + 31 * (epoch + 1)) % B.KEYS, s))[1000 * place : 1000 * (place + 1)]
        own = {s: min(range(3), key=lambda c: (((data[s] - centers[c]) ** 2).sum(), c)) for s in order}
        for c in range(3):
            members = [data[s] for s in order if own[s] == c]
            if members:
                seen[c] += len(members)
                centers[c] = centers[c] + (np.sum(members, axis=0) - len(members) * centers[c]) / seen[c]
    assert np.abs(np.array(found.centers) - np.array(centers)).max() < 1e-9 and not found.converged


def test_inertia_near_lloyds(spark, points):
    lloyd = K.kmeans_clusters(points, 5)
    found = B.minibatch_clusters(points, 5, how=B.MiniBatch(rounds=30, batch=200))
    assert inertia(found) <= 1.3 * inertia(lloyd)
    assert found.tracks.count() == 3000 and len(found.centers) == 5


def test_every_round_has_its_batch(spark, points):
    how = B.MiniBatch(rounds=9, batch=700)
    drawn = B.draw(points, "ingest_seq", how, B.hashed_key("ingest_seq", 1), 3000)
    counts = {r["round"]: (r.n, r.different) for r in drawn.groupBy("round").agg(F.count("*").alias("n"), F.countDistinct("ingest_seq").alias("different")).collect()}
    assert counts == {r: (700, 700) for r in range(9)}


def test_few_rows(spark, points):
    for n, k in ((0, 3), (1, 3), (2, 5), (4, 1)):
        found = B.minibatch_clusters(points.where(F.col("ingest_seq") < n), k, how=B.MiniBatch(rounds=3))
        assert found.tracks.count() == n and all(r.cluster < max(1, min(n, k)) for r in found.tracks.collect())
    with pytest.raises(ValueError):
        B.minibatch_clusters(points, 0)


def test_in_place_of_lloyd(spark):
    tracks = spark.range(400).select(
        F.col("id").alias("ingest_seq"),
        F.concat(F.lit("h"), "id").alias("file_hash"),
        F.concat(F.lit("/m/"), "id").alias("file_path"),
        (F.col("id") % 2 * 90 + 50.0).alias("bpm"),
        (F.col("id") % 4 * 1000 + 100.0).alias("centroid"),
        (F.col("id") % 10 / 10).alias("danceability"),
        F.lit(100.0).alias("duration"),
    )
    fit = lambda *a, **k: B.minibatch_clusters(*a, how=B.MiniBatch(rounds=5, batch=100), **k)
    result = K.cluster_playlists(tracks, 4, fit=fit)
    assert result.tracks.count() == 400 and result.summary.agg(F.sum("size")).first()[0] == 400
