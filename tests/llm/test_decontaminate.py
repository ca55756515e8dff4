import random

import pytest

from corpus import words
from trackweave.llm import decontaminate as d


def edit_distance_inside(window, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "z"
        elif kind == 1:
            out.insert(at, "z")
        else:
            del out[at]
    return "".join(out)


def test_banded_alignment_equals_the_whole_table():
    rng = random.Random(41)
    for _ in range(60):
        window = words(rng, 12)[:60].encode()
        text = (b"xy " + edited(rng, window.decode(), rng.randint(0, 6)).encode() + b" z")[: 60 + 12]
        want = edit_distance_inside(window, text)
        got = d.edits_within(window, text, 4)
        assert (got[0] if got else None) == (want if want <= 4 else None)


def test_no_window_within_its_edits_is_lost(spark):
    rng = random.Random(42)
    how = d.Passages()
    items = [(i, words(rng, rng.choice((4, 8, 20, 60)))) for i in range(30)]
    texts = []
    for i in range(60):
        item = items[i % 30][1]
        texts.append(f"{words(rng, 30)} {edited(rng, item, rng.randint(0, 6))} {words(rng, 30)}" if i % 2 else words(rng, 80))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in d.leaks(docs, benchmark).collect()}
    want = {}
    for i, text in enumerate(texts):
        for item, passage in items:
            costs = [
                edit_distance_inside(w, d.normalised(text.encode()))
                for _, w, k in d.windows(d.normalised(passage.encode()), how)
                if edit_distance_inside(w, d.normalised(text.encode())) <= k
            ]
            short = d.normalised(passage.encode())
            if len(short) < how.shortest and f" {short} " in f" {d.normalised(text.encode())} ":
                costs.append(0)
            if costs:
                want[i, item] = min(costs)
    assert got == want and len(want) > 12


def test_case_and_punctuation_do_not_hide(spark):
    rng = random.Random(43)
    item = words(rng, 40)
    text = f"{words(rng, 9)} {item.upper().replace(' ', ', ')} {words(rng, 9)}"
    docs = spark.createDataFrame([(1, text), (2, words(rng, 60))], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    row = d.leaks(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in row] == [(1, 7, 0)]
    assert [r.doc_id for r in d.keep_clean(docs, benchmark).collect()] == [2]


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    rng = random.Random(44)
    items = [(i, words(rng, 20)) for i in range(12)]
    docs = spark.createDataFrame([(i, f"{words(rng, 10)} {t}") for i, t in items], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(d, "BLOCK", 500)
    assert sorted((r.doc_id, r.item_id) for r in d.leaks(docs, benchmark).collect()) == [(i, i) for i in range(12)]


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (2, "too short"), (2, "too short")]])
def test_odd_rows(spark, odd, none, rows):
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    assert d.leaks(odd, benchmark).count() == 0
    kept = d.keep_clean(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == 10
    assert d.leaks(none, benchmark).count() == 0 and d.keep_clean(none, benchmark).count() == 0


def test_repeated_rows_and_items_are_found_one_by_one(spark, odd):
    text = odd.where("doc_id = 1").first().text
    benchmark = spark.createDataFrame([(None, text), (9, text)], "item_id bigint, text string")
    got = d.leaks(odd, benchmark).collect()
    assert sorted(((r.doc_id or 0), (r.item_id or 0)) for r in got) == [(0, 0), (0, 9), (1, 0), (1, 0), (1, 9), (1, 9)]
    assert d.keep_clean(odd, benchmark).count() == 7


def test_excerpts_of_a_window_are_found_at_every_offset(spark):
    rng = random.Random(45)
    item = words(rng, 60)[:300].strip() + "x"
    texts = [f"{words(rng, 12)} {item[at : at + 80]} {words(rng, 12)}" for at in range(len(item) - 79)]
    shorter = [f"{words(rng, 12)} {item[at : at + 60]} {words(rng, 12)}" for at in range(0, 200, 10)]
    docs = spark.createDataFrame(list(enumerate(texts + shorter)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in d.leaks(docs, benchmark).collect()) == list(range(len(texts)))


def test_case_and_punctuation_fold_beyond_ascii(spark):
    rng = random.Random(46)
    item = " ".join("".join(rng.choice("абвгдежзиклмнопрстéüß") for _ in range(6)) for _ in range(20))
    text = f"{words(rng, 9)} «{item.upper().replace(' ', ' – ')}» … {words(rng, 9)}"
    docs = spark.createDataFrame([(1, text), (2, words(rng, 60))], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [(r.doc_id, r.edits) for r in d.leaks(docs, benchmark).collect()] == [(1, 0)]


def test_short_items_are_found_as_whole_words(spark):
    rng = random.Random(47)
    items = [(1, "2+2=4 what is it?"), (2, "Why not him"), (3, "?!"), (4, "why NOT him!"), (None, "tenletters")]
    texts = [
        f"{words(rng, 5)} 2 + 2 = 4, What is it? {words(rng, 5)}",
        "why not hims, swhy not him, whynot him",
        "Why: not him",
        f"{words(rng, 3)} tenletters",
        "xtenletters tenlettersx",
        "why not him why not him",
        "why",
        "not him",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    found = d.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = sorted(((r.doc_id, r.item_id or 0, r.regions, r.edits) for r in found))
    assert got == [(0, 1, 1, 0), (2, 2, 1, 0), (2, 4, 1, 0), (3, 0, 1, 0), (5, 2, 2, 0), (5, 4, 2, 0)]
    assert [(r.start, r.end) for r in found if r.doc_id == 2] == [(0, 11)] * 2
