"""Benchmark passages in documents, found by q-gram lemma filtering and banded alignment.

Two texts of which one has m characters and that are k edits apart share at least
m + 1 - q (k + 1) q-grams, all on diagonals that differ by at most k. So the shared q-grams of a
document and a benchmark item are counted in overlapping diagonal bands; stretches of a band where no
window of the item reaches the bound cannot hold a match, the rest are verified by a banded edit distance.
Windows begin everywhere in an item: those at every ``step`` give the figures of a leak, all others
are tried where these find none.

Characters are code points, compared without case.

The benchmark is the stated query set: it is taken in blocks of a checked size, and every block
passes over all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import blocks, documents, store, utf8
from trackweave.session import settle_small

Q = 12
# Letters and digits count, in lower case; runs of anything else are one space.
PLAIN = bytes(
    c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isupper() else 32
    for c in range(256)
)
OTHER = re.compile(r"[\W_]+")
# Bytes of benchmark text that one pass over the documents looks for: about 130 MB of index in a task.
BLOCK = 4 << 20
# Windows that are aligned at once.
ALIGNED = 512


@dataclass(frozen=True)
class Passages:
    """Windows of ``window`` characters; one edit is allowed for each ``per_edit`` characters.

    A leak's figures are those of the windows at every ``step``, if one of these is found.
    """

    window: int = 80
    step: int = 40
    per_edit: int = 16
    shortest: int = 24  # normalised items below this are found as whole words in a row, without edits


def normalised(text: bytes) -> str:
    if text.isascii():
        return b" ".join(text.translate(PLAIN).split()).decode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text.decode(errors="replace")).casefold())
    return OTHER.sub(" ", folded).strip()


def codes(text: str | bytes) -> np.ndarray:
    """Code points, or bytes."""
    if isinstance(text, bytes):
        return np.frombuffer(text, np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edits_allowed(length: int, how: Passages) -> int:
    # Fewer edits where the bound on shared q-grams would reach zero.
    return max(0, min(length // how.per_edit, length // Q - 1))


def windows(item: str, how: Passages) -> list[tuple[int, str, int]]:
    """(offset, window, edits allowed) at every step of a normalised item; the last one ends with the item."""
    if len(item) < how.shortest:
        return []
    last = max(0, len(item) - how.window)
    texts = [(at, item[at : at + how.window]) for at in [*range(0, last, how.step), last]]
    return [(at, text, edits_allowed(len(text), how)) for at, text in texts]


def grams(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters at every position that has as many."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = text.astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for c in range(Q):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += wide[c : c + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


class Index:
    """Sorted q-grams of some benchmark items."""

    BITS = 20

    def __init__(self, items: list[tuple[int, bytes]], how: Passages):
        self.item, self.text, self.steps, all_grams = [], [], [], []
        self.short: dict[str, list[int | None]] = {}
        for item, raw in items:
            text = normalised(raw)
            if len(text) < how.shortest:
                if text:
                    self.short.setdefault(text, []).append(item)
                continue
            self.item.append(item)
            self.text.append(codes(text))
            self.steps.append([at for at, _, _ in windows(text, how)])
            all_grams.append(grams(self.text[-1]))
        sizes = np.array([len(g) for g in all_grams], np.int64)
        joined = np.concatenate([np.empty(0, np.uint64), *all_grams])
        order = np.argsort(joined, kind="stable")
        self.grams = joined[order]
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.offset = (np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order].astype(np.int32)
        self.length = np.array([min(len(t), how.window) for t in self.text], np.int64)  # of the item's windows
        self.last = np.array([len(t) for t in self.text], np.int64) - self.length
        self.edit = np.array([edits_allowed(n, how) for n in self.length.tolist()], np.int64)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.grams >> np.uint64(64 - self.BITS)] = True

    def exact(self):
        """An automaton over the short items; None without any."""
        if not self.short:
            return None
        automaton = ahocorasick.Automaton()
        for text, items in self.short.items():
            automaton.add_word(text, (len(text), items))
        automaton.make_automaton()
        return automaton

    def regions(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first diagonal of the band, first and last window offset) where the shared q-grams reach the bound."""
        hashes = grams(text)
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.BITS)])
        low = np.searchsorted(self.grams, hashes[at], "left")
        many = np.searchsorted(self.grams, hashes[at], "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        if not len(at):
            return []
        where = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, offset = self.owner[where].astype(np.int64), self.offset[where].astype(np.int64)
        # Diagonals above zero.
        diagonal = np.repeat(at, many) - offset + self.last[item] + self.length[item]
        # Bands are 2k + 1 diagonals wide at a distance of k + 1: any k + 1 neighbours lie within one.
        band = diagonal // (self.edit[item] + 1)
        item, offset = np.concatenate([item, item]), np.concatenate([offset, offset])
        band = np.concatenate([band, band - 1])
        order = np.lexsort((offset, band, item))
        item, band, offset = item[order], band[order], offset[order]
        # A window holds enough of them if it begins where ``bound`` hits in a row fit in.
        bound = self.length[item] + 1 - Q * (self.edit[item] + 1)
        span = self.length[item] - Q
        end = np.minimum(np.arange(len(item)) + bound - 1, len(item) - 1)
        enough = np.arange(len(item)) + bound - 1 < len(item)
        enough &= (item[end] == item) & (band[end] == band) & (offset[end] - offset <= span)
        item, band, start, end = item[enough], band[enough], offset[enough], offset[end[enough]]
        first = np.maximum(end - span[enough], 0)
        stop = np.minimum(start, self.last[item])
        first, stop, item, band = (x[first <= stop] for x in (first, stop, item, band))
        out: list[tuple[int, int, int, int]] = []
        diagonals = band * (self.edit[item] + 1) - self.last[item] - self.length[item]
        for i, d, a, b in zip(item.tolist(), diagonals.tolist(), first.tolist(), stop.tolist()):
            if out and out[-1][:2] == (i, d) and a <= out[-1][3] + 1:
                out[-1] = (i, d, out[-1][2], max(b, out[-1][3]))
            else:
                out.append((i, d, a, b))
        return out


def edits_within(window: str | bytes, text: str | bytes, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``window`` anywhere in ``text``, if at most ``most`` edits are needed."""
    edits, ends = aligned(codes(window)[None], codes(text)[None], np.array([len(text)]))
    return (int(edits[0]), int(ends[0])) if edits[0] <= most else None


def aligned(wanted: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best place of each row of ``wanted`` anywhere in its row of ``texts``.

    A row of ``texts`` counts up to its length; it is as long as the window and a band on both sides, so
    its columns are the band.
    """
    n, width = texts.shape
    steps = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)  # a match may begin anywhere
    for i in range(1, wanted.shape[1] + 1):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (texts != wanted[:, i - 1 : i]), out=new[:, 1:])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)  # insertions along the row
        new += steps
        row = new
    row[steps[None] > lengths[:, None]] = 1 << 30
    ends = row.argmin(axis=1)
    return row[np.arange(n), ends], ends


def _searched(index: Index):
    def placed(joined: np.ndarray, tried: Iterator[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, edits, end) of each (row, item, window offset, from, to) of ``tried``."""
        for size, same in groupby(tried, lambda x: int(index.length[x[1]])):
            while part := list(islice(same, ALIGNED)):
                wanted = np.stack([index.text[i][o : o + size] for _, i, o, _, _ in part])
                lengths = np.array([b - a for *_, a, b in part])
                texts = np.zeros((len(part), lengths.max()), np.uint32)
                for k, (*_, a, b) in enumerate(part):
                    texts[k, : b - a] = joined[a:b]
                edits, ends = aligned(wanted, texts, lengths)
                for (r, item, _, a, _), cost, end in zip(part, edits.tolist(), ends.tolist()):
                    if cost <= index.edit[item]:
                        yield r, item, cost, a + end

    def whole(text: str, starts: np.ndarray, automaton) -> Iterator[tuple[int, int | None, int, int]]:
        """(row, item, begin, end) of the short items that stand in ``text`` as whole words."""
        for last, (size, items) in automaton.iter(text):
            begin, end = last + 1 - size, last + 1
            if (begin == 0 or text[begin - 1] in " \n") and (end == len(text) or text[end] in " \n"):
                r = int(np.searchsorted(starts, begin, "right")) - 1
                for item in items:
                    yield r, item, begin - int(starts[r]), end - int(starts[r])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = index.exact()
        for block in blocks(batches, "text"):
            texts = [normalised(t) for t in utf8(block.column("text"))]
            # One buffer for the block; no q-gram of a window holds the separator.
            line = "\n".join(texts)
            joined = codes(line)
            starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
            regions = sorted(index.regions(joined), key=lambda x: int(index.length[x[0]]))

            def places(stepped: bool, known: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
                for item, diagonal, low, high in regions:
                    most, size, steps = int(index.edit[item]), int(index.length[item]), index.steps[item]
                    for offset in [x for x in steps if low <= x <= high] if stepped else range(low, high + 1):
                        first = diagonal + offset
                        # The band's two diagonals at either side may lie in the next document.
                        ends = np.clip([first + most, first + most + size], 0, len(joined) - 1)
                        for r in {*(np.searchsorted(starts, ends, "right") - 1).tolist()}:
                            a = max(first - most, int(starts[r]))
                            b = min(first + 3 * most + size, int(starts[r]) + len(texts[r]))
                            if a < b and (r, index.item[item]) not in known:
                                yield r, item, offset, a, b

            found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
            for stepped in (True, False):
                for r, item, edits, end in placed(joined, places(stepped, set(found))):
                    end -= int(starts[r])
                    old = found.get((r, index.item[item]), (0, 1 << 60, 0, 1 << 60))
                    begin = min(old[1], max(0, end - int(index.length[item])))
                    found[r, index.item[item]] = (old[0] + 1, begin, max(old[2], end), min(old[3], edits))
            for r, item, begin, end in whole(line, starts, automaton) if automaton else ():
                old = found.get((r, item), (0, 1 << 60, 0, 0))
                found[r, item] = (old[0] + 1, min(old[1], begin), max(old[2], end), 0)
            ids = block.column("doc_id").take(pa.array([r for r, _ in found], pa.int64()))
            hashes = block.column("text_hash").take(pa.array([r for r, _ in found], pa.int64()))
            items = pa.array([i for _, i in found], pa.int64())
            rest = [pa.array([v[c] for v in found.values()], pa.int64()) for c in range(4)]
            yield pa.record_batch([ids, hashes, items, *rest], ["doc_id", "text_hash", "item_id", "regions", "start", "end", "edits"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, how: Passages) -> DataFrame:
    items = documents(benchmark, "item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // BLOCK))
    texts = documents(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    kinds = "doc_id bigint, text_hash bigint, item_id bigint, regions bigint, start bigint, end bigint, edits bigint"
    found = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        index = Index([(r.item_id, r.text.encode()) for r in part.collect()], how)
        found.append(texts.mapInArrow(_searched(index), kinds))
    return reduce(DataFrame.union, found)


def leaks(docs: DataFrame, benchmark: DataFrame, how: Passages = Passages()) -> DataFrame:
    """(doc_id, item_id, regions, start, end, edits): the items found in each row of ``docs`` (doc_id, text).

    ``regions`` counts the windows and bands that verified, ``start`` and ``end`` bound them in the normalised text,
    ``edits`` is the best region's. Null and empty texts hold and leak nothing, nor do items without a letter or digit; items
    under ``shortest`` characters are found as whole words without edits; repeated rows are searched one by one, a null item_id stays null.
    """
    return _found(docs, benchmark, how).drop("text_hash")


def keep_clean(docs: DataFrame, benchmark: DataFrame, how: Passages = Passages()) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns as they were.

    Null and empty texts stay, repeated rows share their fate, rows that share only a doc_id are told apart by their
    texts; an empty benchmark keeps all, an empty table gives none.
    """
    found = _found(docs, benchmark, how)
    bad = settle_small(store(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()))
    met = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"])
    return docs.join(bad, met, "left_anti")
