import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpus import words
from trackweave.llm import golay, simhash


def plain_print(text):
    ws = text.encode().lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, near):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_words_within_a_bit_share_a_codeword():
    rng = np.random.default_rng(1)
    for x in rng.integers(0, 1 << 23, 300):
        own = golay.near_codewords(np.array([x]))[0]
        around = golay.near_codewords(np.array([x] + [x ^ (1 << b) for b in range(23)]))
        assert all(set(own[own >= 0]) & set(other[other >= 0]) for other in around)
        assert (own >= 0).sum() in (1, 6)


def test_fingerprints_within_three_bits_share_a_key():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = rng.integers(0, 1 << 63, dtype=np.uint64)
        y = x
        for b in rng.choice(64, 3, replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        rows, keys = simhash.document_keys(np.array([[x], [y]], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_counts_beyond_one_byte_lane():
    text = " ".join(f"w{i % 700}" for i in range(3000))
    assert int(simhash.fingerprints([text.encode()], 3, 1)[0, 0]) == plain_print(text)


def chained(rng, n):
    """Fingerprints in chains of small steps, clusters and loners."""
    prints = []
    for _ in range(n):
        x = rng.getrandbits(64) if not prints or rng.random() < 0.3 else rng.choice(prints)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    return sorted(set(prints))


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(3)
    prints = chained(rng, 400)
    ids = list(range(len(prints)))
    expected = roots(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    rows = [(i, bytearray(x.to_bytes(8, "big")), bytearray(x.to_bytes(8, "big"))) for i, x in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node bigint, checked binary, routed binary")
    # A limit of four members deals most buckets out by chunks.
    for limit in (simhash.GROUP, 4):
        got = dict(simhash.components(simhash.links(nodes, 3, limit)).collect())
        assert {i: got.get(i, i) for i in ids} == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200}


def test_query_equals_brute_force(spark):
    rng = random.Random(4)
    base = words(rng, 300)
    texts = [base, base.upper(), base + " more", words(rng, 50), words(rng, 2), "", "  ", "one", words(rng, 50)]
    docs = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i + 10: plain_print(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert all(len(r.fingerprint) == 16 for r in got.values())
    expected = roots(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in got.items()} == expected


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert [r.component_id for r in rows if r.doc_id == 1] == [1, 1]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd, simhash.similar_texts()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in (1, 2, 4, 6, 6)]
    assert simhash.keep_one(none, simhash.similar_texts()).count() == 0


def test_groups_without_any_id_keep_one(spark):
    rng = random.Random(6)
    a, b = words(rng, 100), words(rng, 100)
    docs = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id bigint, text string")
    assert sorted(r.text for r in simhash.keep_one(docs, simhash.similar_texts()).collect()) == sorted([a, b])


def test_similar_texts_go_and_others_stay(spark):
    rng = random.Random(7)
    texts = [words(rng, 300) for _ in range(20)]
    near = []
    for t in texts[:10]:
        ws = t.split()
        ws[rng.randrange(300)] = "changed"
        near.append(" ".join(ws))
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs, simhash.similar_texts(0.8, 5)).collect()}
    assert kept == set(range(20))


def shingles(text):
    ws = text.split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_a_shared_repeated_phrase_does_not_make_texts_similar(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        phrase = words(rng, 5)
        for _ in range(2):
            texts.append(" ".join([words(rng, 130), *[phrase] * 24]))
    assert max(jaccard(a, b) for a in texts for b in texts if a is not b) < 0.1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert simhash.keep_one(docs, simhash.similar_texts(0.8, 5)).count() == len(texts)


def test_set_forest_connects_what_all_pairs_connect():
    rng = random.Random(9)
    near = simhash.similar_texts(0.8, 5)
    for _ in range(30):
        sets = [set(rng.sample(range(1000), 20))]
        for _ in range(25):
            new = set(rng.choice(sets))
            for _ in range(rng.randint(0, 4)):
                new.add(rng.randrange(1000))
            sets.append(new)
        ids = list(range(len(sets)))
        expected = roots(ids, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
        arrays = [np.array(sorted(s)) for s in sets]
        # Some are known to be connected.
        known = np.array([expected[i] if i % 3 else i for i in ids])
        got = list(simhash.set_forest(arrays, known, near))
        assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in got)
        linked = {frozenset(x) for x in got} | {frozenset((i, j)) for i in ids for j in ids if known[i] == known[j]}
        assert roots(ids, lambda a, b: frozenset((a, b)) in linked) == expected


def pair_at(rng, n, low, how):
    """A text and a near copy whose similarity is just above ``low``: one block replaced, or text appended."""
    text = words(rng, n).split()
    for k in range(n // 3, 0, -1):
        at = rng.randrange(n - k + 1)
        other = [*text[:at], *words(rng, k).split(), *text[at + k :]] if how == "block" else [*text, *words(rng, k).split()]
        if jaccard(" ".join(text), " ".join(other)) >= low:
            return " ".join(text), " ".join(other)


def test_keys_propose_isolated_pairs_at_the_limit():
    rng = random.Random(10)
    near = simhash.similar_texts(0.8, 5)
    for how in ("block", "appended"):
        texts = [t for _ in range(150) for t in pair_at(rng, rng.choice((60, 120, 250)), 0.8, how)]
        keys = simhash.band_keys(simhash.shingle_sets([t.encode() for t in texts], 5), near)
        assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.99


def test_isolated_pairs_at_the_limit_go_and_those_below_stay(spark):
    rng = random.Random(11)
    near = [t for i in range(60) for t in pair_at(rng, 150, 0.8, ("block", "appended")[i % 2])]
    far = [t for i in range(20) for t in pair_at(rng, 150, 0.76, ("block", "appended")[i % 2])]
    assert all(jaccard(a, b) < 0.8 for a, b in zip(far[::2], far[1::2]))
    docs = spark.createDataFrame(list(enumerate(near + far)), "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs, simhash.similar_texts(0.8, 5)).collect()}
    assert kept == set(range(0, 120, 2)) | set(range(120, 160))


def test_large_buckets_meet_by_chunks(spark):
    rng = random.Random(12)
    base = words(rng, 120).split()
    texts = []
    for i in range(40):
        at = rng.randrange(100)
        texts.append(" ".join([*base[:at], *words(rng, rng.choice((8, 12, 20))).split(), *base[at + 12 :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    near = simhash.similar_texts(0.8, 5)
    prints = docs.withColumn("text_hash", F.xxhash64("text"))
    prints = prints.mapInArrow(simhash._sketched(near), "doc_id bigint, text_hash bigint, node bigint, keys array<bigint>").cache()
    nodes = [r.node for r in prints.orderBy("doc_id").collect()]
    whole, chunked = (
        dict(simhash.components(simhash._similar_links(docs, prints, near, limit)).collect()) for limit in (1 << 20, 300)
    )
    expected = roots(list(range(40)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    for got in (whole, chunked):
        named = [got.get(n, n) for n in nodes]
        assert all((named[a] == named[b]) == (expected[a] == expected[b]) for a in range(40) for b in range(40))


def test_near_fingerprints_propose_pairs_of_similar_texts(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(12):
        base = words(rng, 400)
        texts += [base, f"{base} {words(rng, 1)}"]
    near = simhash.similar_texts(0.8, 5)
    sets = simhash.shingle_sets([t.encode() for t in texts], 5)
    prints = simhash.set_prints(sets)
    close = [i for i in range(0, 24, 2) if int(np.bitwise_count(prints[i] ^ prints[i + 1]).sum()) <= 3]
    assert len(close) >= 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        simhash._printed(near), "doc_id bigint, text_hash bigint, node bigint, keys array<bigint>, checked binary"
    )
    # Without a MinHash key in common, the fingerprints alone must bring the pairs together.
    rows = rows.withColumn("keys", F.array("node")).cache()
    nodes = [r.node for r in rows.orderBy("doc_id").collect()]
    found = simhash._similar_links(docs, rows, near, 1 << 20, simhash.near_prints(rows))
    linked = {frozenset(r) for r in found.collect()}
    assert linked == {frozenset((nodes[i], nodes[i + 1])) for i in close}
