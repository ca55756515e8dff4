import random
import re

from corpus import words
from trackweave.llm import licenses


def base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(ws))
        if ws[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), labels


def test_base_columns_equal_brute_force(spark):
    texts = [
        "Under the MIT License, under-the-mit-license",
        "CC BY NC CC BY NC cc_by\x00nc é cc by ncx",
        "Apache License, Version 2.0 apache license version 20",
        "İ Straße under the mit license",
        "",
        words(random.Random(31), 500),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def telling_words(notice, spaced, start, end):
    """Whether the telling words stand in order among the words that a match touches; long ones with one edit."""
    import regex

    wanted = licenses.TELLING.get(licenses.NOTICES[notice], {}).get(notice.split()[0], "").split()
    touched = spaced[spaced.rfind(" ", 0, start + 1) : (spaced + " ").find(" ", end - 1)].split()
    for word in touched:
        if wanted and (word == wanted[0] or len(wanted[0]) >= 8 and regex.fullmatch(f"(?:{wanted[0]}){{e<=1}}", word)):
            wanted = wanted[1:]
    return not wanted


def brute(spaced):
    """Labels of the notices that are somewhere within their edits, without seeds."""
    import regex

    out = {}
    for notice, label in licenses.NOTICES.items():
        edits = len(notice) // licenses.PER_EDIT
        m = regex.search(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}", spaced)
        if m and telling_words(notice, spaced, *m.span()):
            out[notice] = label
    return out


def test_seeds_lose_no_notice_within_its_edits():
    rng = random.Random(32)
    for notice, label in licenses.NOTICES.items():
        for _ in range(6):
            text = list(notice)
            for _ in range(rng.randint(0, len(notice) // licenses.PER_EDIT)):
                at = rng.randrange(len(text))
                kind = rng.randrange(3)
                if kind == 0:
                    text[at] = "q"
                elif kind == 1:
                    text.insert(at, "q")
                else:
                    del text[at]
            spaced = f" {words(rng, 20)} {''.join(text)} {words(rng, 20)} "
            found = {label for *_, label, _ in licenses.fuzzy_spans(spaced.encode())}
            assert found <= set(brute(spaced).values())
            # Lost only with its telling words: the edits may have hit them.
            assert found or not telling_words(notice, spaced, spaced.find(" ", 1), len(spaced) - 1) or not brute(spaced)


def test_nearest_notice_wins():
    for text, label in (
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("the GNU General Public License, version 3.", "gpl-3"),
        ("the GNU Generel Public Licence, version 2.", "gpl-2"),
    ):
        row = licenses.scan_text(text.encode())
        assert row[5] == label and 0 < row[6] <= 1


def test_every_place_of_many_notices():
    one = b" gnu general public license version 2"
    spans = licenses.fuzzy_spans(one * 200 + b" ")
    assert [s[0] for s in spans] == [1 + len(one) * i for i in range(200)]
    row = licenses.scan_text(b"under the MIT license. " * 2000)
    assert row[:4] == (8000, 2000, 0, 7996)


def test_odd_rows(odd, none):
    rows = licenses.scan(odd).collect()
    assert len(rows) == 10 and {r.labels for r in rows} == {""} and {r.score for r in rows} == {0.0}
    assert {r.n_words for r in rows if r.doc_id in (2, 3, 5)} == {0}
    assert licenses.scan(none).count() == 0


def test_other_licences_are_not_taken_for_these():
    for text in (
        "released under the bsd license",
        "released under the gpl license",
        "released under the isc license",
        "licensed under cc by nd 4 0",
        "gnu general public license version 1",
        "gnu library general public license version 1",
        "mozilla public license version 1 1",
        "licensed under the apache license version 1 1",
    ):
        assert licenses.scan_text(text.encode())[5] in ("",), text
    for text, label in (
        ("relesed under teh mit license", "mit"),
        ("licenced under cc by nc 4 0", "cc-by-nc"),
        ("creative commons atribution noncomercial", "cc-by-nc"),
        ("gnu lesser genral public licence", "lgpl"),
    ):
        assert licenses.scan_text(text.encode())[5] == label, text
