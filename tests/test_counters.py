from pyspark.sql import functions as F

from trackweave.operators.counters import store_counted, store_playlists


def metrics():
    return {"n": F.count("*"), "odd": F.count_if(F.col("id") % 2 == 1), "most": F.max("id")}


def test_metrics_equal_a_scan_of_what_was_written(spark):
    df = spark.range(1000).where("id % 7 <> 0").repartition(5)
    kept, found = store_counted(df, **metrics())
    assert found == kept.agg(*[m.alias(k) for k, m in metrics().items()]).first().asDict()
    assert kept.count() == found["n"]


def test_empty_tables(spark):
    for df in (spark.range(0), spark.range(10).where("false"), spark.range(10).where("id > 20").groupBy("id").count()):
        assert store_counted(df, **metrics())[1] == {"n": 0, "odd": 0, "most": None}


def test_no_job_after_the_write(spark):
    context, df = spark.sparkContext, spark.range(1000)
    context.setJobGroup("counted", "counted")
    try:
        store_counted(df, **metrics())
        written = len(context.statusTracker().getJobIdsForGroup("counted"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # One job writes; reading the footer for the schema is the other.
    assert written <= 2


def test_lost_tracks_are_told(spark):
    tracks = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "playlist string, pos long, file_path string")
    sizes = spark.createDataFrame([("a", 2), ("b", 1)], "playlist string, size long")
    assert store_playlists(tracks, sizes)[1].first().asDict() == {
        "saved_playlists": 2, "saved_tracks": 3, "unnamed": 1, "balanced": True,
    }
    assert not store_playlists(tracks.where("pos = 1"), sizes)[1].first().balanced
    assert store_playlists(tracks.limit(0), sizes.limit(0))[1].first().balanced
