import math
import os.path

import pytest
from pyspark.sql import functions as F

from trackweave.functions import labels as L
from trackweave.functions import paths as P
from trackweave.functions import scalars as N
from trackweave.functions import signal as S


def values(spark, inputs, kind, make):
    """Result of ``make(column x)`` for each input, in order."""
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "ladder",
    [
        L.RULE_TEMPO,
        L.RULE_ENERGY,
        L.RULE_MOOD,
        L.CLUSTER_TEMPO,
        L.CLUSTER_DANCE,
        L.CLUSTER_TIMBRE,
        L.DOCUMENTED_TEMPO,
        L.DOCUMENTED_TIMBRE,
        L.DOCUMENTED_DURATION,
    ],
)
def test_ladders_at_their_bounds(spark, ladder):
    inputs, expected = [], []
    for i, (bound, name) in enumerate(ladder[:-1]):
        inputs += [math.nextafter(bound, -math.inf), bound]
        expected += [name, ladder[i + 1][1]]
    inputs += [-1.0, math.inf, math.nan, None]
    expected += [ladder[0][1], ladder[-1][1], ladder[-1][1], None]
    assert values(spark, inputs, "double", lambda x: L.step_label(x, ladder)) == expected
    names = [n for _, n in ladder]
    index = values(spark, inputs, "double", lambda x: L.step_index(x, ladder))
    assert [None if i is None else names[i] for i in index] == expected


def test_key_groups(spark):
    rows = [(0, 1), (1, 0), (11, None), (12, 1), (-1, 1), (None, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, key int, scale int")
    got = [r[0] for r in df.orderBy("i").select(L.key_group(F.col("key"), F.col("scale"))).collect()]
    assert got == ["C_Major", "C#_Minor", "B_Minor", "", "", ""]


def test_rule_names(spark):
    rows = [("A_Major", "Warm"), ("", "Mellow"), ("", "Balanced"), ("C_Minor", "Bright"), ("", "Crisp")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, m string")
    name = L.rule_name(F.lit("Slow"), F.lit("Chill"), F.col("k"), F.col("m"))
    got = [r[0] for r in df.orderBy("i").select(name).collect()]
    assert got == [
        "Slow_Chill_A_Major_Warm",
        "Slow_Chill_Warm",
        "Slow_Chill",
        "Slow_Chill_C_Minor_Bright",
        "Slow_Chill_Bright",
    ]


def test_cluster_name_falls_back_to_zero_for_all(spark):
    got = values(
        spark, ["120", "loud", None, " 65 "], "string", lambda x: L.cluster_name(x, F.lit("2500"), F.lit("0.9"))
    )
    assert got == ["Upbeat Energetic Bright", "Slow Chill Relaxing", "Slow Chill Relaxing", "Slow Energetic Bright"]


def test_documented_examples(spark):
    rows = [(90.0, 2500.0, 150.0, 0.65), (75.0, 1800.0, 200.0, 0.35), (140.0, 3500.0, 30.0, 0.95), (50.0, 700.0, 61.0, 0.9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b double, c double, d double, e double")
    name = L.documented_name(*[F.col(c) for c in "bcde"])
    got = [r[0] for r in df.orderBy("i").select(name).collect()]
    assert got == [
        "Medium_Bright_Medium_E6_Balanced",
        "Chill_Mellow_Long_E3_Downtempo",
        "Fast_Sharp_Brief_E9_Dance",
        "VerySlow_Dark_Short_E9_Ambient",
    ]


def test_numbers_follow_python(spark):
    texts = ["1.5", " 7 ", "1e3", "nan", "inf", "-Infinity", "abc", "", "1d", "2.0f", "0x10", None, "7", "-3", "3.7"]

    def python_float(text):
        try:
            return float(text) if text is not None else 0.0
        except ValueError:
            return 0.0

    def python_int(text):
        try:
            return int(text) if text is not None else 0
        except ValueError:
            return 0

    assert [str(v) for v in values(spark, texts, "string", N.as_float)] == [str(python_float(t)) for t in texts]
    assert values(spark, texts, "string", N.as_int) == [python_int(t) for t in texts]
    assert values(spark, [3.9, -3.9, math.nan, None], "double", N.as_int) == [3, -3, 0, 0]


def test_clamps_follow_python(spark):
    inputs = [-1.0, 0.0, 0.4, 1.0, 7.0, math.nan, math.inf, None]
    assert values(spark, inputs, "double", N.at_least_zero) == [0.0, 0.0, 0.4, 1.0, 7.0, 0.0, math.inf, None]
    assert values(spark, inputs, "double", N.unit_interval) == [0.0, 0.0, 0.4, 1.0, 1.0, 0.0, 1.0, None]
    assert values(spark, inputs, "double", N.beat_confidence) == [0.0, 0.0, 0.4, 1.0, 1.0, 1.0, 1.0, None]


def test_key_and_scale_indexes(spark):
    assert values(spark, ["C", "F#", "B", "H", None], "string", N.key_index) == [0, 6, 11, -1, -1]
    assert values(spark, ["major", "minor", None], "string", N.scale_index) == [1, 0, 0]


PATHS = [
    "/a/b", "/a//b/./c/../d", "/../a", "/", "//", "///a", "//a/b/", "a/../..", "", ".", "./a/", "a/..", "../../a",
    "/a/b/../../..", "a/./b//c/", "/a/...", "/.hidden/x", "a/../../b", "/x/..y/z..",
]


def test_normalise_path_follows_posix(spark):
    assert values(spark, PATHS, "string", P.normalise_path) == [os.path.normpath(p) for p in PATHS]


def test_host_path(spark):
    paths = ["/music/a/b.mp3", "/music", "/music//c", "/music2/a", "/musical", "/other/a", "/music/../x"]

    def python(path, root="/music", host="/host"):
        path = os.path.normpath(path)
        return os.path.join(host, os.path.relpath(path, root)) if path.startswith(root) else path

    assert values(spark, paths, "string", lambda x: P.host_path(x, "/music/", "/host/")) == [python(p) for p in paths]
    strict = values(spark, paths, "string", lambda x: P.host_path(x, "/music", "/host", strict_prefix=True))
    assert strict[3:5] == ["/music2/a", "/musical"]
    assert values(spark, paths, "string", lambda x: P.host_path(x, "/music", "")) == paths


def test_names_and_extensions(spark):
    assert values(spark, ["a b/c", "__x--y__", "é#1", "日本 ²!", ""], "string", P.sanitise_name) == [
        "a_b_c", "x--y", "é_1", "日本_²", "",
    ]
    files = ["x.MP3", "x.mp3.txt", "mp3", "a/b.FlAc", "x.aac\n", ".ogg"]
    assert values(spark, files, "string", P.is_audio) == [True, False, False, True, False, True]
    assert values(spark, ["/a/b", "b", "/a/"], "string", P.basename) == ["b", "b", ""]


def test_file_key(spark):
    df = spark.sql("SELECT '/m/a.mp3' p, 10L n, 5L t UNION ALL SELECT '/m/a.mp3', NULL, 5L")
    got = {r[0] for r in df.select(P.file_key(F.col("p"), F.col("n"), F.col("t"))).collect()}
    assert "a.mp3_10_5" in got and any(len(k) == 32 for k in got)


def test_measures_of_arrays(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    arrays = [[1.0, -1.0, 1.0], [], None, [0.0, 0.0], [2.0], [float(v) for v in rng.normal(size=500).astype("f4")]]
    for batch in (arrays, arrays[:5]):  # one long array switches to the row-wise form
        df = spark.createDataFrame(list(enumerate(batch)), "i int, x array<float>").coalesce(1)
        rows = df.orderBy("i").select(S.measures(F.col("x")).alias("m")).collect()
        for array, (m,) in zip(batch, rows):
            if array is None:
                assert m is None
                continue
            x = np.asarray(array)
            if not len(x):
                assert (m.rms, m.zcr, m.slope) == (0.0, 0.0, 0.0)
                continue
            energy = (x * x).sum()
            assert m.rms == pytest.approx(math.sqrt(energy / len(x)))
            assert m.zcr == pytest.approx(sum((a > 0) != (b > 0) for a, b in zip(x, x[1:])) / len(x))
            assert m.slope == pytest.approx(math.sqrt((np.diff(x) ** 2).sum() / energy) if energy else 0.0)


def test_array_means(spark):
    nan = math.nan
    got = values(spark, [[1.0, nan, 3.0], [nan], [], None], "array<double>", S.nan_mean)
    assert got[0] == 2.0 and math.isnan(got[1]) and math.isnan(got[2]) and got[3] is None
    got = values(spark, [[1.0, 3.0], [1.0, nan], []], "array<double>", S.plain_mean)
    assert got[0] == 2.0 and math.isnan(got[1]) and math.isnan(got[2])
    assert values(spark, [[4.0], [], None], "array<double>", S.first_number) == [4.0, 0.0, 0.0]
    nested = values(spark, [[[5.0, 6.0]], [[]], []], "array<array<double>>", lambda x: S.first_number(x, nested=True))
    assert nested == [5.0, 0.0, 0.0]
