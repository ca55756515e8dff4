import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpus import words
from trackweave.llm import repeats


def expected(texts, length, keep_first=False):
    """Per text (removed bytes, runs, kept), from every window of every text."""
    places = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places.setdefault(t[p : p + length], []).append((i, p))
    out = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            at = places[t[p : p + length]]
            if (min(at) < (i, p)) if keep_first else len(at) > 1:
                gone[p : p + length] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


def corpus(rng, length):
    """Shared passages in other surroundings, exact copies, edited copies, runs of one letter and of a line."""
    passages = [words(rng, 30).encode() for _ in range(4)]
    texts = [words(rng, 60).encode() for _ in range(8)]
    texts += [words(rng, rng.randint(1, 20)).encode() + p + words(rng, 10).encode() for p in passages for _ in range(4)]
    texts += texts[:3]
    edited = bytearray(texts[5])
    edited[len(edited) // 2] ^= 1
    texts += [bytes(edited), b"a" * (3 * length), b"a" * (length + 7), b"a line\n" * length, b"", b"short"]
    texts += [passages[0] + words(rng, 5).encode() + passages[0]]
    return texts


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_equals_all_windows(spark, monkeypatch, keep_first, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(11)
    texts = [t.decode("latin1").encode() for t in corpus(rng, 60)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")
    how = repeats.Repeats(60, 20, keep_first)
    got = {r.doc_id: r for r in repeats.without_repeats(docs, how).collect()}
    want = expected(texts, 60, keep_first)
    assert {i: (r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == dict(enumerate(want))
    assert sum(w[0] > 0 for w in want) > 15


def test_ranges_inside_a_text_are_joined():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array(["a" * 200_000])], ["doc_id", "text_hash", "text"])
    rows = [r for b in repeats._pieces(repeats.Repeats())(iter([batch])) for r in b.to_pylist()]
    assert len(rows) < 10
    assert sorted(p for r in rows if r["anchor"] is None for p in (r["start"], r["start"] + r["windows"]))[-1] == 199_601


def test_pieces_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    rng = random.Random(12)
    text = words(rng, 400).encode()
    how = repeats.Repeats(60, 20)
    pieces = repeats.cut(text, how)
    assert [p for _, _, s, n in pieces for p in range(s, s + n)] == list(range(len(text) - 59))


def test_smaller_positions_and_factors():
    positions = np.array([3, 1, 2, 0, 5, 4])
    assert repeats.smaller(positions).tolist() == [-1, -1, 1, -1, 3, 3]
    earlier, later = repeats.factors(np.array([7, 7, 2, 7]), np.array([10, 4, 1, 20]))
    assert earlier.tolist() == [True, False, False, True] and later.tolist() == [True, True, False, False]


def test_ranks_follow_the_first_bytes():
    text = np.frombuffer(b"abcabcabcabdabcabcabcabd" * 4, np.uint8)
    ranks = repeats.prefix_ranks(text, 20)
    raw = bytes(text) + b"\0" * 20
    keys = [raw[i : i + 20] for i in range(len(text))]
    order = sorted(set(keys))
    assert ranks.tolist() == [order.index(k) for k in keys]


def test_production_length(spark):
    rng = random.Random(13)
    shared = words(rng, 90)
    texts = [words(rng, 50) + shared + words(rng, 50) for _ in range(5)] + [words(rng, 200), shared[:399]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in repeats.digest(repeats.without_repeats(docs)).collect()}
    for i, (removed, spans, kept) in enumerate(expected([t.encode() for t in texts], 400)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(texts[i].encode()), removed, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_odd_rows(odd, none):
    rows = repeats.without_repeats(odd).collect()
    counts = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in rows)
    plain = next(r.n_bytes for r in rows if r.doc_id == 1)
    assert counts[1, plain, plain] == 2 and counts[None, plain, plain] == 1
    assert counts[2, 0, 0] == counts[3, 0, 0] == counts[None, 0, 0] == 1 and len(rows) == 10
    kept = repeats.without_repeats(odd, repeats.Repeats(keep_first=True)).collect()
    assert Counter((r.doc_id, r.n_removed) for r in kept if r.n_bytes == plain) == {(1, 0): 2, (None, plain): 1}
    assert repeats.without_repeats(none).count() == 0
