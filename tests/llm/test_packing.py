import random
from collections import defaultdict
from dataclasses import replace
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from corpus import words
from tokenizers import Tokenizer
from trackweave.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
HOW = packing.Packing(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_pieces(tokenizer, text, room=1024):
    """(piece, start, length, crc32) of a text, from the tokenizer's own ids."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    pieces = []
    while ids[:room]:
        pieces.insert(0, ids[-room:])
        ids = ids[:-room]
    out, start = [], 0
    for number, piece in enumerate(pieces):
        out.append((number, start, len(piece), crc32(np.array(piece, "<u4").tobytes())))
        start += len(piece)
    return out


def check(rows, documents, tokenizer, room=1024):
    """Every document whole, every sequence gapless and no longer than allowed; returns the number of sequences."""
    want = sorted(((d, *p) for d, t in documents for p in plain_pieces(tokenizer, t, room)), key=repr)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        place = 0
        for offset, length in sorted(members):
            assert offset == place
            place += length
        assert place <= room
    return len(bins)


def optimum(sizes, room):
    """Fewest bins by exhaustive search."""
    best = len(sizes)

    def go(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[at] <= room and bins[i] not in bins[:i]:
                go(at + 1, [*bins[:i], bins[i] + sizes[at], *bins[i + 1 :]])
        go(at + 1, [*bins, sizes[at]])

    go(0, [])
    return best


def test_ids_equal_the_tokenizers_own(tokenizer):
    rng = random.Random(6)
    signs = [" ", "  ", "\n", "\t", "a", "Bc", "é", "　", "\x1c", "!", "'s", "1", "<|endoftext|>", "\x85", "​", "日", "\r", "😀"]
    texts = ["", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)), words(rng, 5000), "w" * 3000]
    encoder = packing.Encoder(PATH)
    for _ in range(2):  # from nothing, then from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for text in texts[:200]:
        assert "".join(packing.stretches(text, 5)) == text
        assert b"".join(b for s in packing.stretches(text, 5) for b in encoder.ids([s])) == encoder.ids([text])[0]


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(1, 4) == [(0, 1)]


def test_search_only_moves_pieces_and_keeps_filling():
    rng = random.Random(7)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 60))]
        first = packing.best_fit(sizes, 32)
        found = packing.pack(sizes, None, 32)
        fills = [sum(sizes[i] for i in b) for b in found]
        assert sorted(i for b in found for i in b) == list(range(len(sizes)))
        assert max(fills) <= 32 and min(fills) > 0 and len(found) <= len(first)
        assert sum(f * f for f in fills) >= sum(sum(sizes[i] for i in b) ** 2 for b in first)


def test_near_the_optimum():
    rng = random.Random(8)
    over = 0
    for _ in range(60):
        sizes = [rng.randint(3, 20) for _ in range(10)]
        over += len(packing.pack(sizes, None, 32)) - optimum(sizes, 32)
    assert over <= 2
    sizes = [rng.randint(300, 600) for _ in range(3000)]
    assert len(packing.pack(sizes, None, 1024)) < len(packing.best_fit(sizes, 1024))


def test_one_bin_is_emptied():
    # Best fit leaves three bins; the pieces of one fit into the others after exchanges.
    sizes = [6, 5, 5, 4, 3, 3, 2, 2]
    bins = [[0, 3], [1, 4, 6], [2, 5, 7]]
    assert sum(sizes) == 30 and len(packing.pack(sizes, bins, 10)) == 3
    assert len(packing.pack([5, 5, 4, 4, 2], [[0, 2], [1, 3], [4]], 11)) == 2


@pytest.mark.parametrize("group", [40, 1 << 15])
def test_documents(spark, tokenizer, group):
    rng = random.Random(9)
    documents = [(i, words(rng, rng.choice([1, 5, 30, 60, 200, 900]))) for i in range(150)]
    documents += [(500 + i, "the same short text") for i in range(60)]
    docs = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(4)
    rows = packing.sequences(docs, replace(HOW, group=group)).collect()
    tokens = sum(p[2] for _, t in documents for p in plain_pieces(tokenizer, t))
    assert check(rows, documents, tokenizer) <= -(-tokens // 1024) + 1


def test_odd_rows(spark, odd, none, tokenizer):
    rows = packing.sequences(odd, HOW).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], tokenizer)
    empty = packing.sequences(none, HOW)
    assert empty.collect() == [] and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_query(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = queries.op13_swap_packing(spark, "/root/testdata/sf0.001").collect()
    documents = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(rows, documents, tokenizer) <= -(-sum(r.length for r in rows) // 1024) + 2
