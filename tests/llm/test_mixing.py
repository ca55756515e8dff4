import math
import random
from collections import Counter

import pytest
from corpus import words
from pyspark.sql import functions as F
from trackweave.llm import mixing


def corpus(spark, sizes, seed=51):
    rng = random.Random(seed)
    rows = []
    for source, docs in sizes.items():
        rows += [(source, words(rng, rng.randint(5, 40))) for _ in range(docs)]
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string")


def plain_weights(tokens, target):
    """Exponent and weights by plain bisection."""
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}

    def at(a):
        raw = {s: q**a for s, q in shares.items()}
        return {s: r / sum(raw.values()) for s, r in raw.items()}

    def flat(a):
        w = at(a)
        if target.entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) > target.entropy * math.log(len(w))
        rates = [w[s] / shares[s] for s in w]
        return max(rates) * (target.budget if target.budget is not None else 1 / min(rates)) > target.repeats

    low, high = 0.0, 1.0
    if not flat(0.0):
        return at(0.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if flat(mid) else (low, mid)
    return at(high)


SIZES = {"huge": 300, "mid": 60, "small": 9, "tiny": 2}


@pytest.mark.parametrize(
    "target",
    [
        mixing.Target(),
        mixing.Target(repeats=1.5),
        mixing.Target(repeats=None, entropy=0.8),
        mixing.Target(repeats=3.0, budget=1.0),
        mixing.Target(repeats=1000.0),
    ],
)
def test_weights_and_uses(spark, target):
    docs = corpus(spark, SIZES)
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    tokens = Counter()
    for i, s in source.items():
        tokens[s] += size[i]
    weights = plain_weights(tokens, target)
    total = sum(tokens.values())
    rates = {s: weights[s] / (tokens[s] / total) for s in tokens}
    scale = target.budget if target.budget is not None else 1 / min(rates.values())
    rows = mixing.mix(docs, target).collect()
    used = Counter((r.source, r.epoch) for r in rows)
    given = Counter()
    for r in rows:
        assert r.tokens == size[r.doc_id] and r.source == source[r.doc_id] and 0 <= r.block < target.blocks
        given[r.source] += r.tokens
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    for s, docs_of in SIZES.items():
        quota = rates[s] * scale * tokens[s]
        whole = int(quota / tokens[s] + 1e-6)
        # The quota is met to within the document that crosses it.
        assert quota - 0.01 <= given[s] <= quota + 40
        assert all(used[s, e] == docs_of for e in range(whole))
    if target.budget is None:
        assert {r.doc_id for r in rows} == set(size)


def test_blocks_hold_each_source_in_its_share(spark):
    target = mixing.Target(blocks=5)
    rows = mixing.mix(corpus(spark, {"a": 400, "b": 200}), target).collect()
    per = Counter()
    for r in rows:
        per[r.block, r.source] += r.tokens
    for s in "ab":
        own = [per[b, s] for b in range(5)]
        assert max(own) - min(own) <= 100
    # An epoch's order is a permutation that another seed changes.
    other = mixing.mix(corpus(spark, {"a": 400, "b": 200}), mixing.Target(blocks=5, seed=7)).collect()
    assert {(r.doc_id, r.block) for r in rows} != {(r.doc_id, r.block) for r in other}


def test_result_is_the_same_again(spark):
    docs = corpus(spark, SIZES)
    first, second = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(3)))
    assert first == second


def test_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    uses = Counter((r.doc_id, r.source, r.tokens) for r in rows)
    assert uses[3, None, 0] == uses[2, "a", 0] == uses[5, "a", 0] == uses[None, None, 0] == 1
    assert {(r.doc_id, r.source) for r in rows} == {(r.doc_id, r.source) for r in odd.collect()}
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("text IS NULL")).count() == 2


def test_uses_carry_their_own_text(spark, odd, none):
    rows = [(1, "a", "one text"), (1, "a", "another text"), (None, "a", "no id"), (2, None, None), (3, "b", "twice"), (3, "b", "twice"), (4, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("epoch", F.lit("x"))
    uses = mixing.mix(docs).collect()
    texts = mixing.mixed_texts(docs).collect()
    columns = ["doc_id", "source", "tokens", "epoch", "block", "order_key"]
    assert sorted((tuple(r[c] for c in columns) for r in texts), key=repr) == sorted(map(tuple, uses), key=repr)
    assert {(r.doc_id, r.source, r.text) for r in texts} == set(rows)
    assert all(r.tokens == len((r.text or "").split()) for r in texts)
    given = {(r.doc_id, r.text) for r in odd.collect()}
    assert {(r.doc_id, r.text) for r in mixing.mixed_texts(odd).collect()} == given
    assert mixing.mixed_texts(none).collect() == []
