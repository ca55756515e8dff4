import os
import random
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, connect  # noqa: E402

from trackweave.catalog import cluster_queries  # noqa: E402
from trackweave.functions import labels as L  # noqa: E402
from trackweave.operators import clustering, medians  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


def test_tracks_are_not_joined_with_themselves(spark):
    plan = cluster_queries.kmeans_playlists(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not [line for line in joins if "file_hash" in line]
    assert "percentile(" not in plan


def test_names_by_steps_are_those_of_the_medians(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([69.0, 71.0, 100.0, 131.0]), rng.choice([299.0, 303.0, 5000.0]), rng.random()) for c in range(40) for _ in range(rng.randint(1, 6))]
    points = spark.createDataFrame(rows, "cluster int, bpm double, centroid double, danceability double")
    exact = points.groupBy("cluster").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in clustering.WEIGHTS])
    name = L.underscored(L.cluster_name(F.col("bpm"), F.col("centroid"), F.col("danceability")))
    want = {r.cluster: r.cluster_name for r in exact.select("cluster", name.alias("cluster_name")).collect()}
    got = {r.cluster: r.cluster_name for r in cluster_queries._names_by_steps(points).collect()}
    assert got == want and len(set(want.values())) > 5


def test_large_tables_equal_their_sql(spark, monkeypatch):
    """Sampled start, rounds over all tracks, and medians by narrowing, as for tables beyond the limits."""
    monkeypatch.setattr(clustering, "START_ROWS", 2000)
    summary = clustering.cluster_summary
    monkeypatch.setattr(clustering, "cluster_summary", lambda tracks: summary(tracks, 200))
    assert compare(spark, connect(SF_DIR), SF_DIR, "kmeans_playlists")[1:] == (14851, "equal")


def test_columns_share_the_passes_of_narrowing(spark):
    """Jobs that scan the rows do not grow with the columns, and a round has two of them."""
    rows = spark.range(20_000).selectExpr("CAST(id % 3 AS INT) AS k", "CAST(hash(id) AS DOUBLE) AS a", "CAST(hash(id, 1) AS DOUBLE) AS b")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = rows.mapInArrow(counted, rows.schema)
    medians.narrowed_medians(watched, "k", ["a", "b"], 1000).collect()
    assert seen.value <= 4 * 20_000
