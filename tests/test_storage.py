import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trackweave.operators.extraction import extract_measures, measures_from_samples
from trackweave.plans import jobs as J
from trackweave.plans.output import save_failed, save_playlists
from trackweave.schema import MEASURES
from trackweave.sources.files import list_files, too_small
from trackweave.sources.m3u import open_filesystem, outer_path, playlist_of, read_m3u
from trackweave.sources.table import FeatureTable, KeyedTable
from trackweave.streaming.ingest import upsert_stream, watch_directory

# Executors do not have this file: its extractor functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def feature_rows(spark, entries):
    """(hash, path, bpm, last_modified) as feature rows without sequence numbers."""
    df = spark.createDataFrame(entries, "file_hash string, file_path string, bpm double, last_modified double")
    others = {c: F.lit(0 if c in ("key", "scale") else 0.0) for c in MEASURES if c != "bpm"}
    return df.withColumns({**others, "last_analyzed": F.lit("2024-01-01").cast("timestamp_ntz")})


def rows_of(table):
    return {r.file_hash: (r.file_path, r.bpm) for r in table.read().collect()}


def test_table_keeps_newest_row_and_replays_count_once(spark, tmp_path):
    table = FeatureTable(spark, str(tmp_path / "t"), buckets=3)
    assert table.read().count() == 0 and table.read().columns == [f.name for f in table.schema]
    table.append(feature_rows(spark, [("a", "/a", 1.0, 1.0), ("b", "/b", 1.0, 1.0)]), "s", 0)
    second = feature_rows(spark, [("b", "/b2", 2.0, 1.0), ("c", "/c", 2.0, 1.0)])
    table.append(second, "s", 1)
    before = sorted(map(tuple, table.read().collect()))
    table.append(second, "s", 1)  # a replayed batch has the numbers it had
    assert sorted(map(tuple, table.read().collect())) == before
    assert rows_of(table) == {"a": ("/a", 1.0), "b": ("/b2", 2.0), "c": ("/c", 2.0)}
    assert len({r.ingest_seq for r in table.read().collect()}) == 3
    assert os.listdir(tmp_path / "t" / "batches" / "s") == ["1"]


def bucket_files(table):
    return {b: sorted(n for n in os.listdir(f"{table.root}/rows/{b}") if n.endswith(".parquet")) for b in os.listdir(f"{table.root}/rows") if b.startswith("bucket=")}


def test_change_rewrites_touched_buckets_only(spark, tmp_path):
    table = FeatureTable(spark, str(tmp_path / "t"), buckets=8)
    table.append(feature_rows(spark, [(f"h{i}", f"/{i}", 1.0, 1.0) for i in range(60)]))
    before = bucket_files(table)
    for k in range(3):
        table.append(feature_rows(spark, [("h3", "/3", 2.0 + k, 1.0)]))
    after = bucket_files(table)
    assert len(before) == 8 and sum(after[b] != before[b] for b in before) == 1
    rows = table.read()
    assert rows.where("bpm > 1").first().bpm == 4.0 and rows.count() == 60
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    # Numbers go on, also after the rows that had them are gone.
    table.forget(rows.select("file_hash"))
    assert table.read().count() == 0 and len(bucket_files(table)) == 8
    top = table.top()
    table.append(feature_rows(spark, [("new", "/new", 1.0, 1.0)]))
    assert table.read().first().ingest_seq > top >= 62


def test_a_change_may_be_applied_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k string, t int").schema, ["k"], ["t"], buckets=2)
    rows = spark.createDataFrame([("a", 5), ("b", 1)], table.schema)
    for _ in range(2):
        table.append(rows)
        table.forget(rows.where("k = 'b'"))
        assert table.read().collect() == [("a", 5)]
    table.rewrite(spark.createDataFrame([("z", 1)], table.schema))
    assert table.read().collect() == [("z", 1)]


def test_older_files_get_defaults_for_added_columns(spark, tmp_path):
    table = FeatureTable(spark, str(tmp_path / "t"), buckets=4)
    table.append(feature_rows(spark, [(f"h{i}", "/a", 1.0, 1.0) for i in range(9)]))
    old = FeatureTable(spark, str(tmp_path / "old"), buckets=4)
    spark.read.parquet(f"{table.root}/rows").drop("key", "zcr").write.partitionBy("bucket").parquet(f"{old.root}/rows")
    assert {(r.key, r.zcr) for r in old.read().collect()} == {(-1, 0.0)}
    # The first change brings all buckets up to date.
    old.append(feature_rows(spark, [("h3", "/a", 2.0, 1.0)]))
    assert sorted((r.file_hash, r.key) for r in old.read().collect()) == [(f"h{i}", 0 if i == 3 else -1) for i in range(9)]


def test_forgotten_keys_come_back_when_added_again(spark, tmp_path):
    table = FeatureTable(spark, str(tmp_path / "t"), buckets=4)
    table.append(feature_rows(spark, [("a", "/a", 1.0, 1.0), ("b", "/b", 1.0, 1.0), ("c", "/c", 1.0, 1.0)]))
    table.forget(spark.createDataFrame([("a",), ("b",)], "file_hash string"))
    assert [r.file_hash for r in table.read().collect()] == ["c"]
    table.append(feature_rows(spark, [("b", "/b", 5.0, 1.0)]))
    assert {k: v[1] for k, v in rows_of(table).items()} == {"b": 5.0, "c": 1.0}
    assert len({r.ingest_seq for r in table.read().collect()}) == 2


def tracks_of(spark, sizes):
    rows = [(n, o, p, f"/music/{n}/{p}.mp3") for o, (n, s) in enumerate(sizes.items(), 1) for p in range(1, s + 1)]
    df = spark.createDataFrame(rows, "playlist string, playlist_order int, pos long, file_path string").repartition(5)
    summary = df.groupBy("playlist", "playlist_order").agg(F.count("*").alias("size"))
    return df, summary, rows


def test_m3u_files_are_ordered_and_exact(spark, tmp_path):
    tracks, summary, rows = tracks_of(spark, {"A_C#_Major": 3, "B": 25, "C": 1})
    out = str(tmp_path / "out")
    for _ in range(2):  # a rerun overwrites with the same bytes
        save_playlists(tracks, summary, out, "/music", "/host")
    assert sorted(os.listdir(out)) == ["A_C#_Major.m3u", "All_Successful_Tracks.m3u", "B.m3u", "C.m3u"]
    lines = [r[3].replace("/music", "/host") for r in rows]
    assert open(f"{out}/B.m3u").read() == "\n".join(lines[3:28])
    assert open(f"{out}/All_Successful_Tracks.m3u").read() == "\n".join(lines)


def test_parts_are_a_layout_of_their_own(spark, tmp_path):
    out = str(tmp_path / "out")
    tracks, summary, rows = tracks_of(spark, {"A": 3, "B": 25})
    save_playlists(tracks, summary, out)
    save_playlists(tracks, summary, out, layout="parts", lines_per_part=10)
    names = sorted(os.listdir(out))
    assert [n for n in names if n.startswith("B")] == ["B.00000.m3u", "B.00001.m3u", "B.00002.m3u", "B.m3u"]
    whole = "\n".join(open(f"{out}/{n}").read() for n in names if n.startswith("B."[:2]) and n != "B.m3u")
    assert whole == "\n".join(r[3] for r in rows[3:])
    # A short playlist has parts as well: the layout does not depend on sizes.
    assert "A.00000.m3u" in names and len(names) == 1 + 3 + 3 + 3
    assert open(f"{out}/B.m3u").read() == "#PARTS:10\nB.00000.m3u\nB.00001.m3u\nB.00002.m3u"
    found = read_m3u(spark, out)
    assert found.rdd.getNumPartitions() == 7
    lines = sorted((r.playlist, r.line_number, r.line) for r in found.collect())
    assert [x[2] for x in lines if x[0] == "B"] == [r[3] for r in rows[3:]]
    assert [x[1:] for x in lines if x[0] == "All_Successful_Tracks"] == [(i, r[3]) for i, r in enumerate(rows)]
    assert {playlist_of(n) for n in names} == {"A", "B", "All_Successful_Tracks"}
    with pytest.raises(ValueError):
        save_playlists(tracks, summary, out, layout="other")


def test_many_small_parts_share_read_tasks(spark, tmp_path):
    out = str(tmp_path / "out")
    tracks, summary, rows = tracks_of(spark, {"A": 300, "B": 100})
    save_playlists(tracks, summary, out, layout="parts", lines_per_part=2)
    found = read_m3u(spark, out)
    assert 64 <= found.rdd.getNumPartitions() < 150  # for 400 files of lines
    lines = sorted((r.playlist, r.line_number, r.line) for r in found.collect())
    assert [x[1:] for x in lines if x[0] == "All_Successful_Tracks"] == [(i, r[3]) for i, r in enumerate(rows)]
    assert [x[1:] for x in lines if x[0] == "B"] == [(i, r[3]) for i, r in enumerate(rows[300:])]


def test_clean_names_stay_apart(spark, tmp_path):
    out = str(tmp_path / "out")
    tracks, summary, rows = tracks_of(spark, {"Slow_C#_Major": 2, "Slow_C_Major": 2, "D#": 1, "D!": 1})
    save_playlists(tracks, summary, out, clean_names=True)
    files = {n: open(f"{out}/{n}").read().split("\n") for n in os.listdir(out)}
    assert len(files) == 5 and files["Slow_C_Major.m3u"] == [f"/music/Slow_C_Major/{p}.mp3" for p in (1, 2)]
    other = next(v for k, v in files.items() if k.startswith("Slow_C_Major_"))
    assert other == [f"/music/Slow_C#_Major/{p}.mp3" for p in (1, 2)]


def test_failed_files_are_distinct_and_optional(spark, tmp_path):
    out = str(tmp_path / "out")
    failed = spark.createDataFrame([("/m/a",), ("/m/b",), ("/m/a",)], "file_path string")
    assert save_failed(failed.where("false"), out) == 0 and not os.path.exists(out)
    assert save_failed(failed, out, "/m", "/h") == 2
    assert open(f"{out}/Failed_Files.m3u").read().split("\n") == ["/h/a", "/h/b"]
    many = spark.createDataFrame([(f"/m/{i * 37 % 100:03d}",) for i in range(100)], "file_path string").repartition(7)
    assert save_failed(many, out, "/m", "/h", layout="parts", lines_per_part=9) == 100
    found = [(r.line_number, r.line) for r in read_m3u(spark, out).collect()]
    assert sorted(found) == [(i, f"/h/{i:03d}") for i in range(100)]


def make_files(root, names, size=2000):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode().ljust(size, b"\0"))


def extractor(path, source):
    content = source.read()
    if "bad" in path:
        raise ValueError("cannot decode")
    if "none" in path:
        return {}
    number = int("".join(c for c in os.path.basename(path).split(".")[0] if c.isdigit()) or 0)
    return {"duration": len(content) / 44100, "bpm": 60.0 + 30 * (number % 3), "centroid": 900.0, "danceability": 0.4,
            "key": number % 12, "scale": 1}


def test_listing_keeps_every_name(spark, tmp_path):
    names = ["_intro.mp3", ".38 Special/a.mp3", "...And Justice.mp3", "ok.mp3", "sp ace#1.mp3", "x%20?.ogg", "d/e/f/g.FLAC", "c.txt"]
    make_files(tmp_path, names)
    make_files(tmp_path, ["small.ogg"], 10)
    (tmp_path / "empty").mkdir()
    found = list_files(spark, str(tmp_path))
    assert {os.path.relpath(r.file_path, tmp_path) for r in found.collect()} == {*names, "small.ogg"}
    assert {os.path.relpath(r.file_path, tmp_path) for r in list_files(spark, f"file://{tmp_path}").collect()} == {*names, "small.ogg"}
    assert [os.path.basename(r.file_path) for r in too_small(found).collect()] == ["small.ogg"]
    row = found.where("file_path LIKE '%_intro.mp3'").first()
    assert abs(row.last_modified - os.stat(tmp_path / "_intro.mp3").st_mtime) < 1e-3


def test_files_in_dot_folders_are_not_purged(spark, tmp_path):
    music = tmp_path / "music"
    make_files(music, [".38 Special/a.mp3", "b.mp3"])
    workspace = J.Workspace(spark, str(tmp_path / "cache"))
    rows = [(n, f"{music}/{n}", 1.0, 1.0) for n in (".38 Special/a.mp3", "b.mp3", "gone.mp3")]
    workspace.features.append(feature_rows(spark, [*rows, ("else", "/elsewhere/x.mp3", 1.0, 1.0)]))
    gone = J.purge(workspace, list_files(spark, str(music)), f"file://{music}")
    assert [r.file_path for r in gone.collect()] == [f"{music}/gone.mp3"]
    J.purge(workspace, list_files(spark, str(music)), str(music), everywhere=True)
    assert set(rows_of(workspace.features)) == {".38 Special/a.mp3", "b.mp3"}


def test_names_of_uris_are_not_parsed():
    fs, path = open_filesystem("file:///m/a b#1?%20.mp3")
    assert path == "/m/a b#1?%20.mp3"
    assert outer_path("/m", "/m/x") == "/m/x"


def test_extraction_uses_many_tasks(spark):
    files = spark.range(20_000).selectExpr("concat('/nowhere/', id) AS file_path")
    measured = extract_measures(files, extractor)
    tasks = measured.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 16 and sum(r["count"] for r in tasks) == 20_000


def test_full_run_then_cache_then_update(spark, tmp_path):
    music, out, cache = tmp_path / "music", tmp_path / "out", str(tmp_path / "cache")
    make_files(music, [f"d{i % 2}/{i}.mp3" for i in range(30)] + ["bad.mp3", "none.wav", "x.txt"])
    make_files(music, ["tiny.mp3"], 100)
    args = (spark, str(music), "/host", str(out), cache)

    report = J.run_full(*args, extractor, num_playlists=3, layout="single")
    assert (report.ok_files, report.failed_files, report.purged_files, report.saved_tracks) == (30, 3, 0, 30)
    lines = open(out / "All_Successful_Tracks.m3u").read().split("\n")
    assert sorted(lines) == sorted(f"/host/d{i % 2}/{i}.mp3" for i in range(30))
    assert sorted(open(out / "Failed_Files.m3u").read().split("\n")) == ["/host/bad.mp3", "/host/none.wav", "/host/tiny.mp3"]

    def refuse(path, source):
        raise AssertionError(f"{path} was extracted again")

    (music / "bad.mp3").unlink()
    (music / "none.wav").unlink()
    (music / "d0" / "0.mp3").unlink()
    report = J.run_full(*args, refuse, num_playlists=3)
    assert (report.ok_files, report.failed_files, report.purged_files) == (29, 2, 1)

    report = J.run_from_cache(*args)
    assert report.saved_tracks == 29
    workspace = J.Workspace(spark, cache)
    assert workspace.links.read().count() == 29
    first = {r.name: r.id for r in workspace.playlists.read().collect()}

    make_files(music, ["d1/99.mp3"])
    J.run_full(*args, extractor)
    report = J.run_update(*args)
    assert report.saved_tracks == 30 and workspace.links.read().count() == 30
    second = {r.name: r.id for r in workspace.playlists.read().collect()}
    assert all(second[name] == number for name, number in first.items())
    stamp = workspace.playlists.read().agg(F.max("last_updated")).first()[0]
    J.run_update(*args)  # nothing changed: files are written again, the stamp stays
    assert workspace.playlists.read().agg(F.max("last_updated")).first()[0] == stamp


def test_empty_listing_does_not_purge(spark, tmp_path):
    music = tmp_path / "music"
    music.mkdir()
    workspace = J.Workspace(spark, str(tmp_path / "cache"))
    workspace.features.append(feature_rows(spark, [("a", f"{music}/a.mp3", 1.0, 1.0)]))
    with pytest.raises(RuntimeError):
        J.run_from_cache(spark, str(music), "/h", str(tmp_path / "out"), str(tmp_path / "cache"))


def test_measures_from_samples(spark):
    rows = [(1, [0.5, -0.5] * 22050, "3"), (2, [0.5] * 100, "4"), (3, [], "5"), (4, [0.5] * (44100 * 3), "6")]
    df = spark.createDataFrame(rows, "id int, samples array<float>, key string").withColumn("bpm", F.lit("120"))
    got = {r.id: r for r in measures_from_samples(df).collect()}
    assert (got[1].duration, got[1].loudness, got[1].bpm, got[1].key) == (1.0, 0.5, 120.0, -1)
    assert got[1].zcr == pytest.approx(44099 / 44100)
    assert (got[2].loudness, got[2].bpm, got[2].duration) == (0.0, 0.0, pytest.approx(100 / 44100))
    assert got[3].error == "empty audio" and got[1].error is None
    assert (got[4].key, got[4].duration, got[4].centroid) == (6, 3.0, 0.0)


def test_raw_outputs_by_type(spark):
    rows = [(1, [0.5] * 8, "F#", "major", 5.0, [[2.5, 1.0]]), (2, [0.5] * 8, "4", "minor", -1.0, []), (3, [0.5] * 8, "H", None, None, None)]
    kinds = "id int, samples array<float>, key string, scale string, beat_confidence double, onset_rate array<array<double>>"
    df = spark.createDataFrame(rows, kinds)
    got = {r.id: (r.key, r.scale, r.beat_confidence, r.onset_rate) for r in measures_from_samples(df, min_samples=1, min_key_samples=1).collect()}
    assert got == {1: (6, 1, 1.0, 2.5), 2: (4, 0, 0.0, 0.0), 3: (-1, 0, 0.0, 0.0)}


def test_stream_in_one_or_many_batches_gives_one_table(spark, tmp_path):
    batches = [
        [("a", "/a", 1.0, 10.0), ("b", "/b", 1.0, 10.0), ("b", "/b", 2.0, 30.0)],
        [("a", "/a", 3.0, 20.0), ("b", "/b", 3.0, 20.0)],  # the row of b is late
        [("c", "/c", 4.0, 5.0), ("a", "/a", 5.0, 15.0)],
    ]
    source = str(tmp_path / "source")
    for batch in batches:
        feature_rows(spark, batch).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    results = []
    for files in (1, 10):
        table = FeatureTable(spark, str(tmp_path / f"t{files}"), newest_by=["last_modified", "ingest_seq"])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        upsert_stream(stream, table, str(tmp_path / f"p{files}")).awaitTermination()
        results.append(sorted((r.file_hash, r.bpm, r.last_modified) for r in table.read().collect()))
    assert results[0] == results[1] == [("a", 3.0, 20.0), ("b", 2.0, 30.0), ("c", 4.0, 5.0)]


def test_watched_directory(spark, tmp_path):
    music, failures = tmp_path / "music", str(tmp_path / "failures")
    table = FeatureTable(spark, str(tmp_path / "t"))

    def scan():
        watch_directory(spark, str(music), table, failures, extractor, str(tmp_path / "p")).awaitTermination()
        return table.read().count()

    make_files(music, ["1.mp3", "2.mp3", "bad.mp3", "note.txt"])
    assert scan() == 2
    make_files(music, ["3.mp3"])
    assert scan() == 3
    make_files(music, ["d/_hidden.mp3", ".x/.4.mp3"])
    make_files(music, ["2.mp3"], 3000)  # changed: its new content is a row of its own
    assert scan() == 6
    assert scan() == 6
    assert [os.path.basename(r.file_path) for r in spark.read.parquet(failures).collect()] == ["bad.mp3"]


def test_keyed_table_orders_by_given_columns(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, t int").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], ["t"])
    table.append(spark.createDataFrame([("a", 5), ("a", 9)], schema))
    table.append(spark.createDataFrame([("a", 7)], schema))
    assert table.read().collect() == [("a", 9)]


def test_a_bucket_is_written_by_as_many_tasks_as_its_rows_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("trackweave.sources.table.ROWS_PER_TASK", 50)
    schema = spark.createDataFrame([], "k bigint, t int").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], ["t"], buckets=2)
    rows = spark.range(600).select(F.col("id").alias("k"), F.lit(1).alias("t"))
    table.append(rows)
    for bucket in (0, 1):
        files = list((tmp_path / "t" / "rows" / f"bucket={bucket}").glob("*.parquet"))
        # One file has the row without keys.
        assert len(files) >= 3
        counts = [r[0] for r in spark.read.parquet(*map(str, files)).groupBy(F.input_file_name()).count().select("count").collect()]
        assert max(counts) <= 200
    table.append(rows.where("k % 3 = 0").withColumn("t", F.lit(2)))
    table.forget(rows.where("k % 5 = 0").select("k"))
    expected = sorted((k, 2 if k % 3 == 0 else 1) for k in range(600) if k % 5)
    assert sorted(map(tuple, table.read().collect())) == expected
