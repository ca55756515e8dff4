import math
import random

import pytest
from pyspark.sql import functions as F

from trackweave.functions import signal as S
from trackweave.operators import chunks as C
from trackweave.operators.extraction import measures_from_chunks, measures_from_samples

SCHEMA = "k string, samples array<float>"


def tracks_of(spark):
    rng = random.Random(11)
    rows = [(f"t{i}", [rng.uniform(-1, 1) for _ in range(n)]) for i, n in enumerate((1, 2, 6, 7, 8, 13, 500, 1400))]
    rows += [("none", None), ("empty", []), ("zeros", [0.0] * 30), (None, [1.0, -1.0, 2.0])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_chunked_equals_whole(spark, size):
    tracks = tracks_of(spark)
    want = {r.k: r.m for r in tracks.select("k", S.measures(F.col("samples")).alias("m")).collect()}
    got = {r.k: r for r in C.chunk_measures(C.split_samples(tracks, "k", size), "k").collect()}
    assert got.keys() == want.keys()
    for key, row in got.items():
        assert row.whole
        if want[key] is None:
            assert (row.n, row.rms, row.zcr, row.slope) == (0, 0.0, 0.0, 0.0)
        else:
            assert (row.rms, row.zcr, row.slope) == pytest.approx(tuple(want[key]), rel=1e-9)


def test_missing_repeated_and_overlapping_chunks_are_told(spark):
    def whole(*pieces):
        rows = [("a", at, [1.0] * n) for at, n in pieces]
        return C.chunk_measures(spark.createDataFrame(rows, "k string, start bigint, samples array<float>"), "k").first().whole

    assert whole((0, 4), (4, 4), (8, 1)) and whole((8, 1), (0, 4), (4, 4)) and whole((0, 4), (4, 0))
    assert not whole((0, 4), (8, 4))  # a gap
    assert not whole((4, 4))  # no beginning
    assert not whole((0, 4), (0, 4), (8, 4))  # a repeated chunk makes up for the missing one's length
    assert not whole((0, 4), (2, 4))  # overlap
    assert not whole((0, 4), (4, 4), (4, 4))


def test_odd_chunks(spark):
    nan = math.nan
    rows = [("a", 0, None, 1.0), ("b", 0, [1.0, None], 2.0), ("c", 0, [nan, 1.0], 3.0), ("c", 2, [-1.0], 4.0)]
    chunks = spark.createDataFrame(rows, "k string, start int, samples array<float>, energy double")
    got = {r.k: r for r in C.chunk_measures(chunks, "k").collect()}
    assert got["a"].n == 0 and math.isnan(got["b"].rms) and got["b"].zcr == 0.5
    assert got["c"].n == 3 and got["c"].zcr == pytest.approx(2 / 3) and math.isnan(got["c"].slope)
    assert C.chunk_measures(chunks.limit(0), "k").count() == 0


def test_features_of_chunks_equal_those_of_whole_buffers(spark):
    # A null buffer is an empty track once it is cut; whole, its duration is null.
    tracks = tracks_of(spark).where("k <> 'none'").withColumns(
        {"bpm": F.lit(120.0), "key": F.lit("A"), "scale": F.lit("minor"), "error": F.when(F.col("k") == "t6", "broken")}
    )
    gates = {"min_samples": 7, "min_key_samples": 100}
    want = measures_from_samples(tracks, **gates).orderBy("k").collect()
    cut = C.split_samples(tracks, "k", 6)
    got = measures_from_chunks(tracks.drop("samples"), cut, "k", **gates)
    assert got.columns == measures_from_samples(tracks, **gates).columns
    for a, b in zip(want, got.orderBy("k").collect(), strict=True):
        assert a.asDict() == {k: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for k, v in b.asDict().items()}
    lacking = measures_from_chunks(tracks.drop("samples"), cut.where("start <> 6"), "k", **gates).where("k = 't7'").first()
    assert lacking.error == "missing samples" and lacking.bpm == 0.0
    nowhere = measures_from_chunks(tracks.drop("samples"), cut.limit(0), "k", **gates)
    assert {r.error for r in nowhere.collect()} == {"empty audio"}


def test_no_python_in_the_plan(spark, capsys):
    C.chunk_measures(C.split_samples(tracks_of(spark), "k", 7), "k").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
