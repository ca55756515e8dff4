import re

from corpus import words
from trackweave.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def run(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in pii.pseudonymised(docs, key).collect()}


def test_formats_stay_and_values_go(spark):
    texts = [
        "card 4845168114407329, 4845-1681-1440-7329 and 4845 1681 1440 7329.",
        "call +1 (974) 555-3436 27 or (974) 555-3436 or 974-555-3436 or +49 30 1234567",
        "hosts 97.51.17.173, 10.0.0.1.",
        "born 2024-02-29, 29/02/2024, 29.02.2024",
        "ssn 123-45-6789",
        "und.34@mail7.example.com and und.34@mail7.example.com",
    ]
    got = run(spark, texts)
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[0-9]", "9", t))
    for i, text in enumerate(texts):
        if i != 2:
            assert shape(got[i].text) == shape(text)
        assert got[i].text != text
    cards = [re.sub("[ -]", "", c) for c in re.findall(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", got[0].text)]
    assert len(set(cards)) == 1 and luhn(cards[0]) and got[0].n_card == 3
    phones = [re.sub(r"\D", "", p)[-10:] for p in re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", got[1].text)]
    assert len(phones) == 3 and len(set(phones)) == 1 and got[1].text.count(" 27 ") == 1
    assert all(int(p) <= 255 for p in re.findall(r"\d+", got[2].text)) and got[2].n_address == 2
    iso = re.search(r"(\d{4})-(\d\d)-(\d\d)", got[3].text).groups()
    assert got[3].text == f"born {'-'.join(iso)}, {'/'.join(iso[::-1])}, {'.'.join(iso[::-1])}"
    first, second = re.findall(r"\S+@\S+", got[5].text)
    assert first == second and first.endswith("@mail7.example.com")


def test_invalid_values_stay(spark):
    texts = [
        "4845168114407320 0000000000000000 12345678901234567890 x4845168114407329",
        "256.1.1.1 1.2.3.4.5 2023-02-29 2024-13-01 000-12-3456 666-12-3456",
        "version 2.0. in 1999 @home a@b no digits",
    ]
    got = run(spark, texts)
    assert all(got[i].text == t and got[i].n_found == 0 for i, t in enumerate(texts))


def test_permutations_are_one_to_one_and_keyed(spark):
    numbers = spark.range(189 * 773)
    moved = numbers.select("id", pii.permuted_number(numbers["id"], 189, 773, "date", "k").alias("new")).toPandas()
    assert sorted(moved["new"]) == list(range(189 * 773)) and (moved["new"] != moved["id"]).mean() > 0.99
    codes = spark.range(26 * 26 * 10).selectExpr(
        "concat(char(97 + id div 260), char(97 + id div 10 % 26), cast(id % 10 as string)) AS t"
    )
    out = codes.select(pii.permuted_text(codes["t"], pii.F.lit("w"), "k").alias("n")).toPandas()["n"]
    assert out.nunique() == 6760 and out.str.fullmatch("[a-z]{2}[0-9]").all()
    assert run(spark, ["4845168114407329"], "k")[0].text != run(spark, ["4845168114407329"], "other")[0].text


def test_texts_around_finds_are_untouched(spark):
    import random

    rng = random.Random(61)
    parts = [words(rng, 5) for _ in range(4)]
    text = f"{parts[0]} 97.51.17.173{parts[1]}\n4845168114407329 {parts[2]} é 😀 a@b.cc{parts[3]}"
    out = run(spark, [text, "97.51.17.173", text * 300])
    assert out[0].text.startswith(parts[0]) and f"{parts[1]}\n" in out[0].text and " é 😀 " in out[0].text
    assert out[2].text == out[0].text * 300 and out[2].n_found == 300 * out[0].n_found


def test_odd_rows(odd, none):
    rows = pii.pseudonymised(odd, "k").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert sum(r.text is None for r in rows) == 2 and {r.n_found for r in rows} == {0}
    assert pii.pseudonymised(none, "k").count() == 0


def test_no_python_in_the_plan(odd, capsys):
    pii.pseudonymised(odd, "k").explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
