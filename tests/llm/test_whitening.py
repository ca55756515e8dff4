import math
from fractions import Fraction

import numpy as np
import pytest
from trackweave.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, component string, whitened string"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 7, "x", "y") for i, v in vectors], schema)


def plain(vectors, count=32):
    """n, exact deviations, eigenvalues and trace of the vectors, by Fractions and numpy's own solver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    centred = [[Fraction(row[j]) - Fraction(sums[j], n) for j in range(d)] for row in x]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    values, vecs = np.linalg.eigh(cov)
    deviations = [sum((n * row[j] - sums[j]) ** 2 for j in range(d)) for row in x]
    return n, deviations, values[::-1][:count], vecs[:, ::-1][:, :count], np.array(centred, float), np.trace(cov)


def held(rows):
    ids = sorted({r.vec_id for r in rows})
    k = max(r.component for r in rows)
    out = np.full((len(ids), k), np.nan)
    for r in rows:
        out[ids.index(r.vec_id), r.component - 1] = math.nan if r.whitened is None else r.whitened
    return out


@pytest.mark.parametrize("dim", [3, 40])
def test_equals_a_plain_decomposition(spark, dim):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((150, dim)) @ rng.standard_normal((dim, dim))
    vectors = [[float(c) for c in row] for row in data]
    rows = whitening.whiten(frame(spark, list(enumerate(vectors))).repartition(5)).collect()
    n, deviations, values, vecs, centred, trace = plain(vectors)
    assert len(rows) == 150 * min(dim, 32) and {r.n for r in rows} == {150}
    assert {r.vec_id: r.deviation for r in rows} == dict(enumerate(deviations))
    for r in rows:
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9
    found, want = held(rows), centred @ vecs / np.sqrt(values)
    signs = np.sign((found * want).sum(axis=0))
    assert np.abs(found * signs - want).max() < 1e-7
    (error,) = {r.identity_error for r in rows}
    true = np.abs(np.cov(found.T, bias=True) - np.eye(found.shape[1])).max()
    assert error <= 1e-9 and abs(error - true) < 1e-12


def test_counts_certify_the_numbering():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = np.array([9.0, 9.0, 9.0, 4.0, 4 - 1e-10, 2.0, *np.linspace(0, 1, 24)])
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    for shift in (8.0, 3.9, 1.5, 0.5):
        assert whitening.inertia(matrix, shift) == (values > shift).sum()
    found = whitening.leading(matrix, 8)
    assert np.abs(found.values - np.sort(values)[::-1][:8]).max() < 1e-13
    assert found.above.tolist()[:6] == [0, 0, 0, 3, 4, 5] and found.within.tolist()[:6] == [3, 3, 3, 1, 1, 1]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(8)).max() < 1e-14
    assert np.abs(matrix @ found.vectors - found.vectors * found.values).max() < 1e-13


def test_rows_that_go_and_rows_that_stay(spark):
    rng = np.random.default_rng(5)
    good = [[float(c) for c in rng.standard_normal(4)] for _ in range(20)]
    odd = [None, [], [1.0, None, 2.0, 3.0], [math.nan, 1.0, 1.0, 1.0], [1.0, math.inf, 1.0, 1.0], [1.0, 2.0], [1e30, 0.0, 0.0, 0.0]]
    vectors = [*enumerate(good), (0, good[0]), (None, good[1]), *((100 + i, v) for i, v in enumerate(odd))]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert len(rows) == 22 * 4 and {r.n for r in rows} == {22}
    assert {r.vec_id for r in rows} == {*range(20), None}
    assert plain([*good, good[0], good[1]])[1][:20] == [next(r.deviation for r in rows if r.vec_id == i) for i in range(20)]


def test_no_variance_and_no_rows(spark):
    rows = whitening.whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(6)])).collect()
    assert len(rows) == 12 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in rows} == {(None, 0.0, 0, 0.0)}
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(6)])).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True}
    for vectors in ([], [(1, None)]):
        empty = whitening.whiten(frame(spark, vectors))
        assert empty.collect() == [] and empty.columns[:3] == ["vec_id", "component", "n"]


def test_deviation_beyond_a_long(spark):
    rows = whitening.whiten(frame(spark, [(1, [-3e7, 1.0]), (2, [3e7, 0.0])])).collect()
    assert [r.deviation for r in rows if r.component == 1] == [None, None]
    near = whitening.whiten(frame(spark, [(1, [-1e7, 1.0]), (2, [1e7, 0.0])])).collect()
    assert {r.deviation for r in near} == {2 * 0 + (64 * 2 * 10**7) ** 2 + 64**2}


def test_query(spark):
    rows = queries.op12_spectrum_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) % 32 == 0 and {r.component for r in rows} == set(range(1, 33))
    assert next(iter({r.identity_error for r in rows})) < 1e-9
