"""Byte strings that occur more than once in a corpus, by longest-previous-factor arrays.

A window is a string of ``length`` bytes. The gram with the least hash among a window's grams is its
anchor; equal windows have equal anchors at equal places, so neighbouring windows with one anchor
make a piece, and only pieces with equal anchors need to meet:

1. every document is cut into its pieces; a row carries the anchor's and the piece's hash, no text;
2. equal pieces are counted, combined before the shuffle: their windows all repeat;
3. anchors with several different pieces get the text of one piece of each kind. Their windows are
   put in suffix order, and previous and next smaller positions in that order give each window's
   earlier match (the longest previous factor, cut off at ``length``); the same from the other end
   gives later ones;
4. repeated windows become byte ranges of their documents, which are cut from the texts.

No anchor gathers in one task: above ``GROUP`` kinds of pieces its windows are spread by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from trackweave.llm.common import blocks, documents, spread, store, utf8

# Kinds of pieces of one anchor that a task orders at once (a quarter megabyte of text); beyond, they are spread.
GROUP = 512
# Bytes of a text that are cut at once.
CHUNK = 1 << 20
BASE = 0x5851F42D4C957F2D


@dataclass(frozen=True)
class Repeats:
    """Windows of ``length`` bytes with anchors of ``gram`` bytes.

    ``keep_first``: the earliest occurrence stays (by doc_id, then hash of the text, then place); else
    all occurrences go.
    """

    length: int = 400
    gram: int = 128
    keep_first: bool = False


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def rolling(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from every position on, the same wherever they stand."""
    up, down = _powers(CHUNK + 4096)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    x = (sums[size:] - sums[:-size]) * down[: len(text) - size + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from prefix and suffix minima of stretches of that width."""
    n = len(values) - width + 1
    full = -(-len(values) // width) * width
    rows = np.concatenate([values, np.full(full - len(values), values.max())]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def cut(text: bytes, how: Repeats) -> list[tuple[int, int, int, int]]:
    """(anchor, hash, start, windows) of every piece of a text, in order; none for a text below ``length``."""
    out = []
    grams = how.length - how.gram + 1
    for begin in range(0, len(text) - how.length + 1, CHUNK):
        part = text[begin : begin + CHUNK + how.length - 1]
        hashes = rolling(np.frombuffer(part, np.uint8), how.gram)
        # The place in the low bits: the leftmost of equal hashes wins.
        place = np.uint64((1 << 24) - 1)
        least = least_in(hashes & ~place | np.arange(len(hashes), dtype=np.uint64), grams) & place
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        counts = np.diff(np.concatenate([starts, [len(least)]]))
        anchors = hashes[least[starts]].view(np.int64)
        for anchor, start, count in zip(anchors.tolist(), starts.tolist(), counts.tolist()):
            digest = xxh3_64_intdigest(part[start : start + count - 1 + how.length])
            out.append((anchor, digest - (digest >> 63 << 64), begin + start, count))
    return out


PIECES = "doc_id bigint, text_hash bigint, anchor bigint, piece bigint, start bigint, windows int"


def _pieces(how: Repeats):
    """Rows of pieces, each kind once for a document; ranges known to repeat inside it have no anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows, owner = [], []
            for at, text in enumerate(utf8(block.column("text"))):
                first: dict[tuple[int, int], tuple[int, int]] = {}
                again: dict[tuple[int, int], None] = {}
                inner: list[tuple[int, int]] = []  # ranges of windows; neighbours are one range
                for anchor, piece, start, count in cut(text, how):
                    if first.setdefault((anchor, piece), (start, count))[0] != start:
                        again[anchor, piece] = None
                        if inner and sum(inner[-1]) == start:
                            inner[-1] = (inner[-1][0], inner[-1][1] + count)
                        else:
                            inner.append((start, count))
                own = [(anchor, piece, *place) for (anchor, piece), place in first.items()]
                if not how.keep_first:
                    inner += [first[k] for k in again]
                rows += own + [(None, None, *place) for place in inner]
                owner += [at] * (len(rows) - len(owner))
            take = pa.array(owner, pa.int64())
            kinds = [pa.int64()] * 3 + [pa.int32()]
            columns = list(zip(*rows)) or [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.record_batch(
                [block.column("doc_id").take(take), block.column("text_hash").take(take), *arrays],
                ["doc_id", "text_hash", "anchor", "piece", "start", "windows"],
            )

    return run


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of every position by its first ``length`` bytes (zeros follow the end), by prefix doubling."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    value = np.zeros(len(text), np.uint64)
    for b in range(8):
        value = value << np.uint64(8) | padded[b : b + len(text)]
    rank = np.unique(value, return_inverse=True)[1]
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        second = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), rank.dtype)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + 1) + second, return_inverse=True)[1]
        depth += step
    return rank


def smaller(positions: np.ndarray) -> np.ndarray:
    """For each entry of the suffix order the nearest earlier entry with a smaller position, -1 without one."""
    at = np.arange(len(positions)) - 1
    while True:
        bad = np.flatnonzero((at >= 0) & (positions[at] > positions))
        if not len(bad):
            return at
        at[bad] = at[at[bad]]


def factors(ranks: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later): whether each window has an equal one at a smaller, or larger, position.

    Suffix order sorts by rank, then position. The longest previous factor of an entry starts at its
    previous or next smaller position; it has the full length where that has the same rank.
    """
    order = np.lexsort((positions, ranks))
    sorted_ranks, sorted_positions = ranks[order], positions[order]

    def matched(places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), bool)
        for turned in (False, True):
            way = slice(None, None, -1 if turned else 1)
            near = smaller(places[way])
            here = sorted_ranks[way]
            found = (near >= 0) & (here[near] == here)
            out |= found[way]
        return out

    earlier, later = np.empty(len(order), bool), np.empty(len(order), bool)
    earlier[order] = matched(sorted_positions)
    later[order] = matched(-sorted_positions)
    return earlier, later


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _repeated_windows(texts: list[bytes], order: list, how: Repeats) -> list[list[tuple[int, int]]]:
    """Per piece the runs of windows that repeat in another one (or earlier, if the first stays)."""
    counts = np.array([len(t) - how.length + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # Most pieces share only their anchor: pieces without a recurring window hash need no order.
    hashes = np.concatenate([rolling(np.frombuffer(t, np.uint8), how.length) for t in texts])
    _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
    live = np.unique(owner[times[which] > 1])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(live):
        return out
    slim = [texts[i] for i in live]
    starts = np.cumsum([0, *[len(t) for t in slim[:-1]]])
    ranks = prefix_ranks(np.frombuffer(b"".join(slim), np.uint8), how.length)
    chosen = np.isin(owner, live)
    moved = starts[np.searchsorted(live, owner[chosen])] + inside[chosen]
    places = np.empty(len(texts), np.int64)
    places[sorted(range(len(texts)), key=order.__getitem__)] = np.arange(len(texts))
    positions = places[owner[chosen]] * (1 << 24) + inside[chosen]
    earlier, later = factors(ranks[moved], positions)
    flags = np.zeros(len(owner), bool)
    flags[chosen] = earlier if how.keep_first else earlier | later
    edges = np.cumsum(counts)[:-1]
    for i, own in enumerate(np.split(flags, edges)):
        if own.any():
            out[i] = runs(own)
    return out


FOUND = "anchor bigint, piece bigint, first int, stop int"


def _ordered(how: Repeats, size: int = 1 << 19):
    """Repeated runs of windows of the pieces in batches sorted by anchor; an anchor's pieces come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[dict]) -> pa.RecordBatch:
            order = [(r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"], r["start"]) for r in rows]
            each = _repeated_windows([r["text"] for r in rows], order, how)
            flat = [(r["anchor"], r["piece"], a, b) for r, own in zip(rows, each) for a, b in own]
            columns = list(zip(*flat)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "piece", "first", "stop"])

        held: list[dict] = []
        held_bytes = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held_bytes >= size and row["anchor"] != held[-1]["anchor"]:
                    yield found(held)
                    held, held_bytes = [], 0
                held.append(row)
                held_bytes += len(row["text"])
        if held:
            yield found(held)

    return run


TEXTS = "anchor bigint, piece bigint, doc_id bigint, text_hash bigint, start bigint, text binary"


def _sliced(how: Repeats):
    """Text of the wanted pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows = []
            wanted = block.column("wanted").to_pylist()
            ids, hashes = block.column("doc_id").to_pylist(), block.column("text_hash").to_pylist()
            for doc, text_hash, text, pieces in zip(ids, hashes, utf8(block.column("text")), wanted):
                for p in pieces:
                    part = text[p["start"] : p["start"] + p["windows"] - 1 + how.length]
                    rows.append((p["anchor"], p["piece"], doc, text_hash, p["start"], part))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["anchor", "piece", "doc_id", "text_hash", "start", "text"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _windows(how: Repeats):
    """One row for each window of the pieces, with a hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 17):
            texts = block.column("text").to_pylist()
            counts = np.array([len(t) - how.length + 1 for t in texts])
            owner = np.repeat(np.arange(len(texts)), counts)
            first = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
            digests = [xxh3_64_intdigest(t[i : i + how.length]) for t, c in zip(texts, counts) for i in range(c)]
            hashes = pa.array(np.array(digests, np.uint64).view(np.int64))
            rest = block.drop_columns(["text"]).take(pa.array(owner))
            yield rest.append_column("first", pa.array(first)).append_column("window", hashes)

    return run


def _spread_out(texts: DataFrame, how: Repeats) -> DataFrame:
    """FOUND rows of anchors with more kinds of pieces than one task takes: windows meet by their own hash."""
    kinds = "anchor bigint, piece bigint, doc_id bigint, text_hash bigint, start bigint, first int, window bigint"
    windows = texts.mapInArrow(_windows(how), kinds)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "start", "first")
    same = windows.groupBy("anchor", "window").agg(F.count("*").alias("times"), F.min(place).alias("earliest"))
    found = windows.join(same.where("times > 1"), ["anchor", "window"])
    if how.keep_first:
        found = found.where(place > F.col("earliest"))
    return found.select("anchor", "piece", "first", (F.col("first") + 1).alias("stop"))


def repeated_ranges(docs: DataFrame, how: Repeats = Repeats()) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): ``docs`` as (doc_id, text_hash, text), and the byte ranges that repeat.

    ``ranges`` has (doc_id, text_hash, ranges: array of (start, end)) for the documents that have any.
    """
    texts = documents(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    pieces = store(texts.mapInArrow(_pieces(how), PIECES))
    anchored = pieces.where("anchor IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "start")
    kinds = anchored.groupBy("anchor", "piece").agg(
        F.count("*").alias("times"), F.min(place).alias("at"), F.first("windows").alias("windows")
    )
    kinds = store(kinds)
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    # A piece that occurs twice is settled, but shows others what repeats.
    need = kinds.join(several, "anchor")
    wanted = F.struct("anchor", "piece", F.col("at.start").alias("start"), "windows")
    asked = store(
        need.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash")).agg(
            F.collect_list(wanted).alias("wanted")
        )
    )
    met = texts["doc_id"].eqNullSafe(asked["_id"]) & (texts["text_hash"] == asked["_hash"])
    # Rows equal in doc_id and text give a piece twice; one is enough.
    whole = texts.join(asked.hint("shuffle_hash"), met).select("doc_id", "text_hash", "text", "wanted")
    got = whole.mapInArrow(_sliced(how), TEXTS)
    large = several.where(F.col("kinds") > GROUP)
    large = store(large.select("anchor"))
    got = store(got)
    count = spread(docs)
    usual = got.join(large, "anchor", "left_anti").repartition(count, "anchor")
    usual = usual.sortWithinPartitions("anchor", "piece", "doc_id", "text_hash")
    found = usual.mapInArrow(_ordered(how), FOUND).union(_spread_out(got.join(large, "anchor", "left_semi"), how))
    found = store(found)
    if how.keep_first:
        later = kinds.where("times > 1").select("anchor", "piece", F.col("at").alias("kept"), "windows")
        rows = anchored.drop("windows").join(later, ["anchor", "piece"]).where(place > F.col("kept"))
        first = kinds.select("anchor", "piece", "at.doc_id", "at.text_hash", "at.start").join(found, ["anchor", "piece"])
        parts = rows.select("doc_id", "text_hash", F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b"))
        parts = parts.union(first.select("doc_id", "text_hash", F.expr("start + first"), F.expr("start + stop")))
    else:
        full = kinds.where("times > 1").select("anchor", "piece", F.lit(0).alias("first"), F.col("windows").alias("stop"))
        single = found.join(full.select("anchor", "piece"), ["anchor", "piece"], "left_anti")
        rows = anchored.join(full.union(single), ["anchor", "piece"])
        parts = rows.select("doc_id", "text_hash", F.expr("start + first").alias("a"), F.expr("start + stop").alias("b"))
    inner = pieces.where("anchor IS NULL").selectExpr("doc_id", "text_hash", "start", "start + windows")
    parts = parts.union(inner)
    span = F.struct(F.col("a").alias("start"), (F.col("b") - 1 + how.length).alias("end"))
    ranges = parts.groupBy("doc_id", "text_hash").agg(F.collect_list(span).alias("ranges"))
    return texts, ranges


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        rows = []
        for text, ranges in zip(utf8(block.column("text")), block.column("ranges").to_pylist()):
            spans = merged(ranges)
            at, parts = 0, []
            for a, b in spans:
                parts.append(text[at:a])
                at = b
            rows.append((len(text), sum(b - a for a, b in spans), len(spans), b"".join([*parts, text[at:]])))
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        yield pa.record_batch([block.column("doc_id"), *arrays], names)


def without_repeats(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of ``docs`` (doc_id, text): ``kept`` is its text without repeats.

    Texts are UTF-8 bytes, so ``kept`` is binary: a cut may fall inside a character. A null text is empty;
    texts below ``length`` are kept whole. Repeated rows are occurrences like others when nothing is kept;
    with ``keep_first`` rows equal in doc_id and text count as one. A null doc_id comes last in order.
    """
    texts, ranges = repeated_ranges(docs, how)
    ranges = ranges.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "ranges")
    met = texts["doc_id"].eqNullSafe(ranges["_id"]) & (texts["text_hash"] == ranges["_hash"])
    joined = texts.join(ranges.hint("shuffle_hash"), met, "left").select("doc_id", "text", "ranges")
    kinds = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return joined.mapInArrow(_kept, kinds)


def digest(kept: DataFrame) -> DataFrame:
    """The result of ``without_repeats`` with a hash in place of the text."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
