import random
import zlib

import numpy as np
import pytest
from corpus import words
from trackweave.llm import classifier as c

SMALL = c.Network(filters=8, embedding=4, epochs=6, sample=400)


def junk(rng, n):
    return " ".join(w + rng.choice(("###", "$$$", "%%%")) for w in words(rng, n).split())


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(81)
    docs = [(i, junk(rng, rng.randint(30, 200)) if i % 4 == 0 else words(rng, rng.randint(30, 200))) for i in range(500)]
    labels = [(i, int(i % 4 != 0), 0) for i, _ in docs]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = c.score(docs, c.fit(docs, labels, SMALL), SMALL).collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in out]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_used(labelled, spark):
    docs, labels = labelled
    flipped = labels.withColumn("quality", c.F.when(c.held_out("doc_id"), 1 - c.F.col("quality")).otherwise(c.F.col("quality")))
    a, b = c.fit(docs, labels, SMALL), c.fit(docs, flipped, SMALL)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_junk_in_the_last_chunk_is_seen(labelled):
    docs, labels = labelled
    w = c.fit(docs, labels, SMALL)
    rng = random.Random(82)
    clean = words(rng, 2000)
    a, b = c.probabilities([clean.encode(), (clean + " " + junk(rng, 30)).encode()], w, SMALL)
    assert a != b


def test_pooling_equals_one_pass_over_all_positions():
    rng = np.random.default_rng(83)
    w = c.start_weights(SMALL)
    for n in (0, 1, 7, 8, 255, 256, 264, 1000, 5003):
        text = rng.integers(32, 127, n).astype(np.uint8).tobytes()
        starts = c.chunk_starts(n, SMALL)
        data = text.ljust(int(starts[-1]) + SMALL.chunk + SMALL.width, b"\0")
        tops = []
        for s in starts:
            values = []
            for p in range(s, s + SMALL.chunk + 1, SMALL.stride):
                x = np.concatenate([w["bytes"][data[p + j]] for j in range(SMALL.width)])
                values.append(x @ w["filters"] + w["bias"])
            tops.append(np.maximum(np.max(values, axis=0), 0))
        features = np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)])
        w["out"][:] = np.linspace(-1, 1, len(w["out"]))
        want = 1 / (1 + np.exp(-(features @ w["out"] + w["offset"][0])))
        assert c.probabilities([text], w, SMALL)[0] == pytest.approx(want, abs=1e-5)
        assert starts[-1] + SMALL.chunk + SMALL.width >= n


def test_gradient_equals_differences():
    rng = np.random.default_rng(84)
    net = c.Network(filters=3, embedding=2)
    texts = [c._padded(rng.integers(0, 256, n).astype(np.uint8).tobytes(), net) for n in (3000, 0, 200, 700)]
    labels = np.array([0, 1, 0, 1], np.float64)
    w = {k: v.astype(np.float64) for k, v in c.start_weights(net).items()}
    w["out"][:], w["bias"][:] = np.linspace(-1, 1, len(w["out"])), (0.1, -0.2, 0.3)

    def loss():
        raw = [t.tobytes() for t in texts]
        p = []
        for text in raw:
            n = (len(text) - net.chunk - net.width) // net.chunk + 1
            top, _ = c._peaks(np.frombuffer(text, np.uint8), net.chunk * np.arange(n), w, net)
            pooled = np.maximum(top, 0)
            p.append(c._sigmoid(np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)]) @ w["out"] + w["offset"])[0])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log1p(-np.array(p)))

    got = c.gradients(texts, labels, w, net, at_once=5)
    for name in w:
        flat = w[name].reshape(-1)
        for i in rng.choice(len(flat), min(len(flat), 12), replace=False):
            keep, step = flat[i], 1e-5
            flat[i] = keep + step
            above = loss()
            flat[i] = keep - step
            below = loss()
            flat[i] = keep
            assert got[name].reshape(-1)[i] == pytest.approx((above - below) / (2 * step), abs=2e-4), name


def test_marks_anywhere_in_long_texts_are_learned(spark):
    net = c.Network(epochs=30, batch=16, rate=0.02)  # 240 texts need more and larger steps than SMALL takes
    rng = random.Random(85)
    docs, labels = [], []
    for i in range(240):
        parts = [words(rng, 12) for _ in range(40)]
        if i % 2:
            parts[rng.choice((20, 39))] = "@@@@ #### @@@@ ####"  # in the middle or at the end, nowhere else
        docs.append((i, " ".join(parts)))
        labels.append((i, int(i % 2 == 0), 0))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    w = c.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), net)
    out = [r for r in c.score(docs, w, net).collect() if r.held_out]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in out]) > 0.95


def test_bounds_of_the_sample(labelled):
    docs, labels = labelled
    few = c.Network(filters=4, embedding=2, epochs=1, budget=5000, longest=800)
    w = c.fit(docs, labels, few)
    short = docs.where("octet_length(text) <= 800")
    again = c.fit(short, labels, few)
    assert any(not np.array_equal(w[k], v) for k, v in c.start_weights(few).items())
    assert all(np.array_equal(w[k], again[k]) for k in w)


def test_odd_rows(odd, none, labelled):
    docs, labels = labelled
    w = c.fit(docs, labels, SMALL)
    rows = c.score(odd, w, SMALL).collect()
    assert len(rows) == 10 and not any(r.held_out for r in rows if r.doc_id is None)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert c.score(none, w, SMALL).count() == 0
    prior = c.fit(none, labels.limit(0), SMALL)
    assert {r.score for r in c.score(odd, prior, SMALL).collect()} == {0.5}
    nulls = labels.sparkSession.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, None), (1, 1, None)], labels.schema)
    assert set(c.fit(odd, nulls, SMALL)) == set(w)
