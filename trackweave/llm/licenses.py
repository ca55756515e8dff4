"""Licence notices in texts: fixed phrases, and fuzzy search for short notices.

A notice that is at most k edits away from some text holds, cut into k + 1 pieces, at least one
piece without an edit (pigeonhole). The pieces are found exactly; around each candidate the regex
library's bounded-error matching verifies the whole notice and gives its span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trackweave.llm.common import blocks, documents, utf8

# Words are runs of letters, digits and everything from 0x80 on, in lower case.
GAPS = bytes(
    32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 65 <= c <= 90 else c
    for c in range(256)
)
# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices searched with errors, and the labels they add.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons zero public domain dedication": "cc0",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved no part of this": "all-rights-reserved",
}
# Words that tell a notice from those of other licences: they must be there, whole, in this order. The edits are for the rest;
# one of them may fall into a word of LONG characters or more.
TELLING = {
    "mit": {"released": "mit"},
    "apache-2": {"licensed": "apache 2"},
    "cc-by-nc": {"licensed": "cc by nc", "creative": "noncommercial"},
    "cc-by-sa": {"licensed": "cc by sa", "creative": "sharealike"},
    "cc0": {"creative": "zero"},
    "gpl-3": {"gnu": "gnu 3"},
    "gpl-2": {"gnu": "gnu 2"},
    "lgpl": {"gnu": "gnu lesser"},
    "agpl": {"gnu": "gnu affero"},
    "mpl-2": {"mozilla": "mozilla 2"},
}
LONG = 8
PER_EDIT = 10  # characters of a notice for each edit allowed


def pieces(notice: str) -> tuple[int, list[tuple[int, bytes]]]:
    """Edits allowed and the exact seeds (offset, bytes): one more than edits, which cover the notice."""
    edits = len(notice) // PER_EDIT
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return edits, [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


@cache
def _compiled() -> list[tuple[str, str, int, list[tuple[int, bytes]], regex.Pattern]]:
    out = []
    for notice, label in NOTICES.items():
        edits, seeds = pieces(notice)
        pattern = regex.compile(rb"(?b)(?:" + regex.escape(notice.encode(), literal_spaces=True) + b"){e<=%d}" % edits)
        out.append((notice, label, edits, seeds, pattern))
    return out


@cache
def _telling(notice: str) -> regex.Pattern | None:
    """What the words of a match must hold; a notice's first word chooses among those of its label."""
    words = TELLING.get(NOTICES[notice], {}).get(notice.split()[0])
    if words is None:
        return None
    parts = [f"(?:{regex.escape(w)}){{e<=1}}" if len(w) >= LONG else regex.escape(w) for w in words.split()]
    return regex.compile("(?: .*)? ".join(["", *parts]).removeprefix("(?: .*)?").encode() + b" ")


def told_apart(notice: str, spaced: bytes, start: int, end: int) -> bool:
    """Whether the whole words that a match touches hold the notice's telling ones."""
    pattern = _telling(notice)
    if pattern is None:
        return True
    start, end = spaced.rfind(b" ", 0, start + 1), spaced.find(b" ", end - 1)
    return pattern.search(spaced, max(start, 0), end + 1 if end >= 0 else len(spaced)) is not None


def words_of(text: bytes) -> list[bytes]:
    return text.translate(GAPS).split()


def base_places(spaced: bytes) -> list[tuple[int, str]]:
    """(offset in ``spaced``, label) of every phrase; ``spaced``: words with one space before, between and after."""
    found = []
    for phrase, label in PHRASES.items():
        needle, at = b" " + phrase.encode() + b" ", -1
        while (at := spaced.find(needle, at + 1)) >= 0:
            found.append((at, label))
    return found


def fuzzy_spans(spaced: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of the notices found with errors, as byte offsets of ``spaced``."""
    found = []
    for notice, label, edits, seeds, pattern in _compiled():
        starts = set()
        for offset, seed in seeds:
            at = -1
            while (at := spaced.find(seed, at + 1)) >= 0:
                starts.add(max(0, at - offset))
        reach = 0
        for start in sorted(starts):
            if start + edits < reach:
                continue  # inside the last match
            m = pattern.search(spaced, max(start - edits, reach), min(len(spaced), start + len(notice) + 2 * edits))
            if m and told_apart(notice, spaced, m.start(), m.end()):
                found.append((m.start(), m.end(), label, sum(m.fuzzy_counts)))
                reach = m.end()
    # Notices differ in a version or a letter: of those over the same words the nearest is meant.
    kept: list[tuple[int, int, str, int]] = []
    for span in sorted(found, key=lambda s: (s[3] / (s[1] - s[0]), s[0] - s[1], s[2])):
        at = bisect_left(kept, span)
        if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or span[1] <= kept[at][0]):
            kept.insert(at, span)
    return kept


def scan_text(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list]:
    words = words_of(text)
    spaced = b" " + b" ".join(words) + b" "
    base = base_places(spaced)
    base_labels = {label for _, label in base}
    fuzzy = fuzzy_spans(spaced)
    # A notice's share of unedited characters is its certainty; a base phrase is certain.
    score = 1.0 if base else max([1 - edits / (end - start) for start, end, _, edits in fuzzy], default=0.0)
    labels = ",".join(sorted(base_labels | {label for _, _, label, _ in fuzzy}))
    spans, word, counted = [], -1, 0
    for a, _, label, e in fuzzy:
        word, counted = word + spaced.count(b" ", counted, a + 1), a + 1
        spans.append((label, word, e))
    first, last = [spaced.count(b" ", 0, pick(base)[0]) for pick in (min, max)] if base else (None, None)
    return len(words), len(base), first, last, ",".join(sorted(base_labels)), labels, score, spans


COLUMNS = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans array<struct<label:string,word:bigint,edits:bigint>>"
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    span = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("edits", pa.int64())]))
    for block in blocks(batches, "text"):
        columns = list(zip(*[scan_text(t) for t in utf8(block.column("text"))])) or [()] * 8
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        spans = [[{"label": a, "word": w, "edits": e} for a, w, e in row] for row in columns[7]]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        yield pa.record_batch([block.column("doc_id"), *arrays, pa.array(spans, span)], names)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its licence phrases (``n_base`` places), labels, score and fuzzy spans.

    ``labels`` holds the base labels and those of the notices found with errors; ``score`` is 1 with a base
    phrase, else the best notice's share of unedited characters, else 0. A null or empty text has no
    words and no labels (empty strings); repeated rows and null ids are scanned like others.
    """
    return documents(docs, "doc_id", "text").mapInArrow(_scanned, COLUMNS)
