import math
import random
import re
from collections import Counter

import pytest
from trackweave.llm import bag_ranking, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def small(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(documents, items, top=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    bags = [(d, small(t)) for d, t in documents]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scores = []
        for doc, terms in bags:
            if not terms:
                continue
            m = 100 - 75 + (75 * len(terms) * n_docs) // n_terms
            tf = Counter(terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in small(text)
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort(key=lambda s: s[:3])
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(scores[:top], 1)]
    return out


def same(found, want):
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def texts(rng, n, vocabulary):
    return [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 40))) for _ in range(n)]


VOCABULARY = ["the", "Of", "ÄÖ", "été", "x1", "q", "long-word", "A_b", "zeta", "日本", *(f"w{i}" for i in range(60))]


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_equals_brute_force(spark, chunk):
    rng = random.Random(10)
    documents = list(enumerate(texts(rng, 300, VOCABULARY)))
    rng.shuffle(documents)
    # Copies of one text, and texts that differ only outside the items' terms.
    documents += [(1000 + i, "w3 w3 the zeta") for i in range(40)] + [(2000 + i, f"w3 w3 the other{i}") for i in range(30)]
    items = list(enumerate(texts(rng, 12, VOCABULARY[:50]))) + [(50, "w3 w3 zeta"), (51, "nowhere"), (52, "The the THE")]
    docs = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(5)
    found = bag_ranking.rank(docs, spark.createDataFrame(items, "item_id bigint, text string"), bag_ranking.Ranking(chunk=chunk))
    same(found.collect(), plain(documents, items))


def test_classes_share_a_score_and_are_told_apart():
    chunk = bag_ranking.Chunk.of([(1, "a b b"), (2, "b c")])
    one, other = (bag_ranking.bag(t, chunk.vocabulary) for t in (b"A x b y", b"b a z z"))
    assert one == other and one[0] == 4
    assert bag_ranking.bag(b"a b b b", chunk.vocabulary)[1] != one[1]
    assert bag_ranking.bag(b"x y", chunk.vocabulary) == (2, None)


def test_long_texts_are_split_between_terms(monkeypatch):
    rng = random.Random(11)
    text = " ".join("é" * rng.randint(1, 9) + "-ab" for _ in range(300)).encode() + b"." + b"w" * 400 + b" end"
    whole = [t for part in bag_ranking.terms(text) for t in part]
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(bag_ranking, "PIECE", size)
        assert [t for part in bag_ranking.terms(text) for t in part] == whole


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    plain_text = rows[0][1]
    wanted = [(1, plain_text), (1, plain_text), (2, None), (3, ""), (None, plain_text[:40]), (4, rows[6][1][:300])]
    items = spark.createDataFrame([(*i, "x", 5) for i in wanted], "item_id bigint, text string, score string, rank int")
    same(bag_ranking.rank(odd, items).collect(), plain(rows, wanted))
    assert bag_ranking.rank(none, items).collect() == []
    nothing = bag_ranking.rank(odd, items.where("false"))
    assert nothing.collect() == [] and nothing.columns == ["item_id", "rank", "doc_id", "score"]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    documents = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    same(queries.op11_bag_ranking(spark, path).collect(), plain(documents, items))
