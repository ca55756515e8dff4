"""What the physical plans must and must not contain."""

import re

from pyspark.sql import functions as F

from trackweave.operators import cache as C
from trackweave.operators import clustering as K
from trackweave.operators import grouping as G
from trackweave.schema import FEATURES_SCHEMA


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, rows=2000):
    base = spark.range(rows).select(
        F.concat(F.lit("h"), "id").alias("file_hash"),
        F.concat(F.lit("/m/"), F.col("id") % 1900).alias("file_path"),
        (F.col("id") % 150 + 40.0).alias("bpm"),
        (F.col("id") * 13 % 8000 + 0.0).alias("centroid"),
        ((F.col("id") % 100) / 100).alias("danceability"),
        (F.col("id") % 13 - 1).cast("int").alias("key"),
        F.lit(1).alias("scale"),
        F.col("id").alias("ingest_seq"),
        F.lit(1.0).alias("last_modified"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("last_analyzed"),
    )
    rest = {f.name: F.lit(0.0) for f in FEATURES_SCHEMA if f.name not in base.columns}
    base.withColumns(rest).select(*FEATURES_SCHEMA.names).write.parquet(str(tmp_path / "f"))
    return spark.read.parquet(str(tmp_path / "f"))


def test_scans_are_pruned_and_filtered(spark, tmp_path):
    plan = plan_of(G.code_tracks(stored(spark, tmp_path)))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    for name in ("bpm", "centroid", "danceability"):
        assert f"IsNotNull({name})" in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "loudness" not in schema and "zcr" not in schema and "duration" not in schema
    assert "Exchange" not in plan


def test_rule_playlists_move_tracks_once(spark, tmp_path):
    plan = plan_of(G.rule_playlists(stored(spark, tmp_path), unique_hashes=True).tracks)
    shuffles_of_paths = [
        line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "cell" in line
    ]
    tracks_side = plan[: plan.index("FileScan")]
    assert "SortMergeJoin" not in tracks_side and "NestedLoop" not in plan and "Cartesian" not in plan
    assert shuffles_of_paths and "ArrowEvalPython" not in plan


def test_merge_planning_needs_no_join(spark, tmp_path):
    groups = G.one_partition(G.group_table(G.code_tracks(stored(spark, tmp_path))))
    plan = plan_of(G.merge_map(groups, G.GroupingRules()))
    assert "Join" not in plan and plan.count("Exchange") == 2  # the aggregate's and the single partition


def test_group_ids_are_bounded(spark, tmp_path):
    found = G.group_table(G.code_tracks(stored(spark, tmp_path))).agg(F.min("gid"), F.max("gid")).first()
    assert 0 <= found[0] and found[1] < G.GROUP_LIMIT == 1875


def test_small_batches_do_not_shuffle_the_table(spark, tmp_path):
    features = stored(spark, tmp_path)
    files = features.limit(5).select("file_hash", "file_path", "last_modified")
    for plan in (
        plan_of(C.lookup(files, features)),
        plan_of(C.upsert(features, features.limit(5), ["file_hash"], [F.desc("ingest_seq")])),
        plan_of(C.unlink_changed(features.select("file_hash"), features, files)),
    ):
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_cluster_cleaning_and_scaling_stay_narrow(spark, tmp_path):
    plan = plan_of(K.scale_weighted(K.clean_tracks(stored(spark, tmp_path))))
    assert "Exchange" not in plan and "Join" not in plan
