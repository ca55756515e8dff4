import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackweave.operators import cache as C
from trackweave.operators import clustering as K
from trackweave.operators import grouping as G
from trackweave.operators import medians
from trackweave.operators.medians import exact_medians, narrowed_medians
from trackweave.operators.ranking import position_within

FEATURES = "file_hash string, file_path string, bpm double, centroid double, danceability double, key int, scale int, ingest_seq long"


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_positions_equal_one_window_per_group(spark, bits):
    random.seed(1)
    orders = random.sample(range(-(2**40), 2**60), 400) + list(range(600))
    rows = [(o % 7 if o % 3 else 1, o) for o in orders]  # group 1 holds a third and more
    df = spark.createDataFrame(rows, "g int, o long")
    got = position_within(df, ["g"], "o", bits=bits)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("long"))
    assert sorted(map(tuple, got.select("g", "o", "pos").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("direct", [10, 300, 10**6])
def test_medians_are_exact(spark, direct):
    random.seed(2)
    rows = [(0, random.gauss(0, 1), float(random.randrange(3))) for _ in range(3001)]
    rows += [(1, 7.0 if random.random() < 0.7 else random.random() * 1e9, random.expovariate(1)) for _ in range(2000)]
    rows += [(2, 1.0, 2.0), (2, 4.0, -8.0), (3, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(4)
    got = {r.g: r for r in exact_medians(df, "g", ["a", "b"], direct_rows=direct).collect()}
    for g in range(4):
        mine = [r for r in rows if r[0] == g]
        assert got[g].size == len(mine)
        assert got[g].a == pytest.approx(statistics.median(r[1] for r in mine), rel=1e-12)
        assert got[g].b == pytest.approx(statistics.median(r[2] for r in mine), rel=1e-12)


def test_narrowed_medians_of_a_hot_value(spark):
    rows = [(0, 5.0)] * 900 + [(0, float(i)) for i in range(1000, 1101)]
    df = spark.createDataFrame(rows, "g int, a double")
    assert narrowed_medians(df, "g", ["a"], direct_rows=10).first()["median"] == 5.0


def track(seq, path=None, bpm=60.0, centroid=2000.0, dance=0.1, key=-1, scale=0, hash=None):
    return (hash or f"h{seq}", path or f"/m/{seq}", bpm, centroid, dance, key, scale, seq)


def grouped(spark, rows, rules=G.GroupingRules(), unique=False):
    df = spark.createDataFrame(rows, FEATURES).repartition(3)
    result = G.rule_playlists(df, rules, unique)
    lists = {}
    for r in result.tracks.orderBy("playlist_order", "pos").collect():
        lists.setdefault(r.playlist, []).append((r.pos, r.file_path))
    for entries in lists.values():
        assert [p for p, _ in entries] == list(range(1, len(entries) + 1))
    summary = result.summary.orderBy("playlist_order").collect()
    assert [s.playlist for s in summary] == list(lists)
    assert {s.playlist: s["size"] for s in summary} == {n: len(e) for n, e in lists.items()}
    return {n: [p for _, p in e] for n, e in lists.items()}, {s.playlist: s for s in summary}


def collision_rows():
    rows = [track(i) for i in range(600)]  # Slow_Chill, mood Balanced
    rows += [track(1000 + i, centroid=7000.0) for i in range(30)]  # Slow_Chill_Bright, first mood Crisp
    rows += [track(2000 + i, dance=0.6, centroid=4000.0) for i in range(5)]  # merges into Slow_Chill, mood Bright
    return rows


def test_colliding_names_keep_the_last_written(spark):
    lists, summary = grouped(spark, collision_rows())
    assert list(lists) == ["Slow_Chill_Balanced", "Slow_Chill_Bright"]
    assert lists["Slow_Chill_Bright"] == [f"/m/{1000 + i}" for i in range(30)]
    assert summary["Slow_Chill_Bright"].mood_group == "Crisp"


def test_colliding_names_can_be_united(spark):
    lists, _ = grouped(spark, collision_rows(), G.GroupingRules(on_collision="union"))
    assert lists["Slow_Chill_Bright"] == [f"/m/{2000 + i}" for i in range(5)] + [f"/m/{1000 + i}" for i in range(30)]


def test_repeated_hashes_count_once_per_group(spark):
    rows = [track(i) for i in range(25)] + [track(100 + i, hash="h0") for i in range(50)]
    lists, _ = grouped(spark, rows)
    assert lists == {"Slow_Chill": [f"/m/{i}" for i in range(25)]}


def test_unmatched_groups_end_in_various(spark):
    rows = [track(i) for i in range(20)] + [track(50, bpm=200.0, dance=0.9, centroid=9000.0)]
    rows += [track(60, bpm=None), track(61, centroid=None)]
    lists, summary = grouped(spark, rows, unique=True)
    assert list(lists) == ["Slow_Chill", "Various_Tracks"]
    various = summary["Various_Tracks"]
    assert (various.bpm_group, various.energy_group, various.mood_group, various.key_group) == ("Various",) * 3 + (None,)


def test_only_small_groups(spark):
    lists, _ = grouped(spark, [track(3), track(1, bpm=200.0), track(2)])
    assert lists == {"Various_Tracks": ["/m/2", "/m/3", "/m/1"]}


def test_no_usable_track(spark):
    lists, _ = grouped(spark, [track(1, bpm=None)])
    assert lists == {}


def test_split_uses_mood_of_first_group_holding_the_path(spark):
    rows = [track(0, path="/m/shared", centroid=100.0)]  # Slow_Chill_Warm comes first
    rows += [track(1 + i, path="/m/shared" if i == 5 else None) for i in range(520)]
    lists, _ = grouped(spark, rows)
    # The small Warm group joins Slow_Chill; both rows of the shared path split as Warm.
    assert lists["Slow_Chill_Warm"] == ["/m/shared", "/m/shared"]
    assert len(lists["Slow_Chill_Balanced"]) == 519
    own, _ = grouped(spark, rows, G.GroupingRules(split_by="track"))
    assert len(own["Slow_Chill_Warm"]) == 1


GOLDEN = {"0.001": (18, 1485, 0), "0.01": (90, 14851, 22)}


@pytest.mark.parametrize("sf", GOLDEN)
def test_known_counts(spark, sf):
    from trackweave.catalog.inputs import tracks

    summary = G.rule_playlists(tracks(spark, f"/root/testdata/sf{sf}"), unique_hashes=True).summary.collect()
    got = len(summary), sum(s["size"] for s in summary), sum(s.split for s in summary)
    assert got == GOLDEN[sf]


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 9), ("c", 4)], "k string, v int")
    got = C.upsert(old, new, ["k"], [F.desc("v")])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 9), ("c", 4)]


def test_hot_keys_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = C.latest_per_key(rows, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_clean_tracks(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("/a", "120", -5.0, 1.5), ("/b", "fast", 1.0, 0.5), ("/c", None, 1.0, 0.5), (None, "1", 1.0, 0.5), ("/d", "60", nan, nan)],
        "file_path string, bpm string, centroid double, danceability double",
    )
    got = {r.file_path: r for r in K.clean_tracks(df).collect()}
    assert set(got) == {"/a", "/d"}
    assert (got["/a"].bpm, got["/a"].centroid, got["/a"].danceability, got["/a"].duration) == (120.0, 0.0, 1.0, 0.0)
    assert (got["/d"].centroid, got["/d"].danceability) == (0.0, 0.0)


def points(spark, n, spread=1.0):
    random.seed(5)
    rows = [(f"/m/{i}", 60 + 40 * (i % 4) + spread * random.random(), 1000.0 * (i % 4), 0.25 * (i % 4), i) for i in range(n)]
    return spark.createDataFrame(rows, "file_path string, bpm double, centroid double, danceability double, ingest_seq long")


def test_kmeans_playlists_hold_every_track_once(spark):
    df = points(spark, 200)
    result = K.cluster_playlists(df, 8)
    rows = result.tracks.collect()
    assert sorted(r.file_path for r in rows) == sorted(f"/m/{i}" for i in range(200))
    assert len({r.cluster for r in rows}) <= 8
    by_name = {}
    for r in sorted(rows, key=lambda r: (r.playlist_order, r.pos)):
        by_name.setdefault(r.playlist, []).append(r)
    for mine in by_name.values():
        assert [r.pos for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.cluster, r.ingest_seq) for r in mine] == sorted((r.cluster, r.ingest_seq) for r in mine)
    assert {s.playlist: s["size"] for s in result.summary.collect()} == {n: len(m) for n, m in by_name.items()}
    again = K.cluster_playlists(df, 8).tracks.collect()
    assert sorted((r.file_path, r.playlist, r.pos) for r in again) == sorted((r.file_path, r.playlist, r.pos) for r in rows)


@pytest.mark.parametrize("k", [1, 3])
def test_few_clusters(spark, k):
    assert K.cluster_playlists(points(spark, 2, 0.0), k).tracks.count() == 2


def test_one_track_and_none(spark):
    assert K.cluster_playlists(points(spark, 1), 8).tracks.count() == 1
    assert K.cluster_playlists(points(spark, 1).where("false"), 8).tracks.count() == 0
    with pytest.raises(ValueError):
        K.cluster_playlists(points(spark, 3), 0)


def test_merge_by_name_folds_medians_in_cluster_order(spark):
    summary = spark.createDataFrame(
        [(2, 5, 8.0, 1.0, 0.0, "X"), (0, 1, 2.0, 1.0, 0.0, "X"), (1, 7, 9.0, 9.0, 0.9, "Y"), (3, 1, 1.0, 1.0, 0.0, "X")],
        "cluster int, size long, bpm double, centroid double, danceability double, playlist string",
    )
    got = {r.playlist: r for r in K.merge_by_name(summary).collect()}
    assert (got["X"]["size"], got["X"].bpm, got["X"].playlist_order) == (7, (((2 + 8) / 2) + 1) / 2, 1)
    assert (got["Y"]["size"], got["Y"].bpm, got["Y"].playlist_order) == (7, 9.0, 2)


def test_narrowing_goes_on_until_groups_are_small(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("a", float(rng.choice([1, 2]))) for _ in range(300)] + [("b", rng.random()) for _ in range(301)]
    rows += [("c", rng.choice([0.0, 1e300, -1e300, 5.0])) for _ in range(200)] + [("d", 7.0)] * 99
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: statistics.median([v for g, v in rows if g == k]) for k in "abcd"}
    for grid in (medians.GRID, 2):  # a grid of two quantiles narrows nothing
        monkeypatch.setattr(medians, "GRID", grid)
        assert {r.k: r.median for r in medians.narrowed_medians(df, "k", ["v"], 10).collect()} == want


def test_measures_must_be_finite(spark):
    rows = [("/a", 100.0, 1.0, 0.5), ("/b", float("inf"), 2.0, 0.5)]
    df = spark.createDataFrame(rows, "file_path string, bpm double, centroid double, danceability double")
    with pytest.raises(ValueError, match="bpm"):
        K.scale_weighted(K.clean_tracks(df))


def test_rounds_over_all_rows_end_at_rest(spark, monkeypatch):
    """Large tables start from a sample's centers; the rounds that follow see every row and end only at rest."""
    monkeypatch.setattr(K, "START_ROWS", 300)
    random.seed(6)
    rows = [tuple(random.gauss(i % 5 * 2, 1.0) for _ in range(3)) for i in range(4000)]
    columns = [f"{c}_w" for c in K.WEIGHTS]
    scaled = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3).cache()
    found = K.kmeans_clusters(scaled, 5)
    assert found.converged and len(found.centers) == 5
    own = {}
    for *p, c in found.tracks.select(*columns, "cluster").collect():
        far = [sum((a - b) ** 2 for a, b in zip(p, center)) for center in found.centers]
        assert far[c] == min(far)
        own.setdefault(c, []).append(p)
    assert sum(map(len, own.values())) == 4000
    for c, mine in own.items():
        mean = [statistics.fmean(x) for x in zip(*mine)]
        assert sum((a - b) ** 2 for a, b in zip(mean, found.centers[c])) ** 0.5 <= 2 * K.TOLERANCE
    assert not K.kmeans_clusters(scaled, 5, max_iter=1).converged


def test_rare_points_keep_their_centers_where_the_sample_lacks_them(spark, monkeypatch):
    monkeypatch.setattr(K, "START_ROWS", 50)
    # Three far points in as many directions among equal ones.
    far = [f"CAST(IF(id = {1000 * i + 7}, 1000, 0) AS DOUBLE) AS {c}_w" for i, c in enumerate(K.WEIGHTS)]
    scaled = spark.range(3000).selectExpr(*far)
    found = K.kmeans_clusters(scaled, 4)
    assert sorted(r[0] for r in found.tracks.groupBy("cluster").count().select("count").collect()) == [1, 1, 1, 2997]


@pytest.mark.parametrize("n", [1, 2, 8, 16])
def test_nearest_by_plain_columns_is_the_nearest(spark, n):
    random.seed(n)
    centers = [(float(random.randrange(4)), float(random.randrange(4))) for _ in range(n)]
    df = spark.range(200).select((F.col("id") % 9 / 2).alias("a"), (F.col("id") % 7 / 2).alias("b"))
    both = K.place_nearest(df, centers, ["a", "b"]).withColumn("want", K.nearest_center(centers, ["a", "b"])["id"])
    assert both.columns == ["a", "b", "cluster", "want"] and both.where("cluster <> want").isEmpty()

