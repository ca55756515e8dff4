"""Token sequences of a fixed length, filled by swap-based local search.

Documents become pieces of at most ``room`` tokens; a full piece is a sequence of its own. The others are
dealt into groups of bounded size, and every group is packed in one task: best fit in falling size gives the
first bins, then pieces move between underfull bins (one or two of the emptier bin for none, one or
two of the fuller one) as long as the sum of squared fills grows, which empties bins. Underfull bins of all groups are
dealt again, whole, into fewer groups and searched on, until one group is left.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from heapq import heappop, heappush
from itertools import accumulate, chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import blocks, documents, store

# A text's tokens never reach over the beginning of white space, so these parts are encoded alone.
PARTS = re.compile(r"\s*\S+|\s+")
# White space to Python's patterns, but not to the tokenizer's.
DISPUTED = re.compile("[\x1c-\x1f]")
WORD_END = re.compile(r"(?<=\S)[ \n]")
# Characters encoded at once.
STRETCH = 1 << 20
# Parts in a generation of those whose ids a worker remembers (some 80 MB), and the longest of them.
REMEMBERED, PART = 400_000, 48
# Words encoded in one go.
ROW = 256


@dataclass(frozen=True)
class Packing:
    """Sequences of ``room`` tokens; every document ends with the id ``end``; ``group``: pieces packed by one task at once."""

    tokenizer: str
    room: int = 1024
    end: int = 2
    group: int = 1 << 15


# ---------------------------------------------------------------- tokens


def stretches(text: str, size: int | None = None) -> Iterator[str]:
    """A long text in stretches of about ``size`` characters, cut where a word ends and white space begins."""
    size = size or STRETCH
    start = 0
    while len(text) - start > size:
        found = WORD_END.search(text, start + size - 1)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers; parts that have been seen are not encoded again."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes a token stands for
        self.widths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        # Two generations: what was not used again while one filled up is forgotten.
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        raw = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
        ends = list(accumulate(map(len, lists), initial=0))
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with white space before them: encoded in rows, told apart by the bytes their tokens stand for."""
        rows = ["".join(words[i : i + ROW]) for i in range(0, len(words), ROW)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)), "<u4")
        reached = np.cumsum(self.widths[ids])
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        cuts = np.searchsorted(reached, ends)
        if not np.array_equal(reached[cuts], ends):
            return self._encode(words)
        raw, cuts = ids.tobytes(), (4 * (cuts + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of new parts."""
        words = [p for p in parts if p[0].isspace() and not p[-1].isspace()]
        others = [p for p in parts if not p[0].isspace() or p[-1].isspace()]
        found = dict(zip(others, self._encode(others)))
        if words:
            found.update(zip(words, self._encode_words(words)))
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        if any(len(text) > STRETCH for text in texts):
            return [b"".join(ids for s in stretches(text) for ids in self.ids([s])) for text in texts]
        split = [[text] if DISPUTED.search(text) else PARTS.findall(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.former, self.known = self.known, {}
        fresh = set(chain.from_iterable(split)).difference(self.known)
        fresh.discard("")
        again = fresh.intersection(self.former)
        self.known.update((part, self.former[part]) for part in again)
        self.known.update(self._learn(fresh - again))
        out = [b"".join(map(self.known.__getitem__, parts)) for parts in split]
        for part in fresh:
            if len(part) > PART:
                del self.known[part]
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def cut(length: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be short."""
    first = length % room or room
    return [(0, first), *((s, room) for s in range(first, length, room))]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(how: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(how.tokenizer), np.array([how.end], "<u4").tobytes()
        for block in blocks(batches, "text"):
            rows, owner = [], []
            texts = [t or "" for t in block.column("text").to_pylist()]
            for at, ids in enumerate(known.ids(texts)):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, how.room)):
                    rows.append((piece, start, length, crc32(memoryview(ids)[4 * start : 4 * (start + length)])))
                    owner.append(at)
            piece, start, length, crc = (pa.array(c, pa.int64()) for c in zip(*rows))
            yield pa.record_batch(
                [block.column("doc_id").take(pa.array(owner)), piece.cast(pa.int32()), start, length, crc],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


# ---------------------------------------------------------------- bins


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins (lists of places in ``sizes``) by best fit in falling size: each to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_rest: list[list[int]] = [[] for _ in range(room + 1)]  # bins by what they can still take
    some = 0  # bit r: a bin with r left
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[at]
        fits = some >> size
        if fits:
            rest = size + (fits & -fits).bit_length() - 1
            number = by_rest[rest].pop()
            if not by_rest[rest]:
                some &= ~(1 << rest)
            bins[number].append(at)
        else:
            rest, number = room, len(bins)
            bins.append([at])
        rest -= size
        by_rest[rest].append(number)
        some |= 1 << rest
    return bins


class Search:
    """Local search over underfull bins: parcels of one or two pieces change hands while the sum of squared fills grows.

    Parcels are found by their size: a bit set tells the largest useful size, a heap the emptiest bin that holds it.
    Heap entries of the past are dropped when they come up.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], room: int) -> None:
        self.sizes, self.room = sizes, room
        self.bins = [list(b) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        # By kind (one piece, two pieces) and size: heaps of (fill, bin, version, the pieces' sizes).
        self.heaps: list[list[list]] = [[[] for _ in range(room + 1)] for _ in range(2)]
        self.some = [0, 0]
        for number in range(len(bins)):
            self._offer(number)

    def _parcels(self, number: int) -> tuple[set[int], dict[int, tuple[int, int]]]:
        own = sorted(self.sizes[i] for i in self.bins[number])
        single = set(own)
        kinds = sorted(single)
        pairs = {a + b: (a, b) for k, a in enumerate(kinds) for b in kinds[k + 1 :]}
        for a, b in zip(own, own[1:]):
            if a == b:
                pairs[2 * a] = (a, a)
        return single, pairs

    def _offer(self, number: int) -> None:
        if not 0 < self.fill[number] < self.room:
            return
        single, pairs = self._parcels(number)
        for size in single:
            heappush(self.heaps[0][size], (self.fill[number], number, self.version[number], (size,)))
            self.some[0] |= 1 << size
        for size, parts in pairs.items():
            heappush(self.heaps[1][size], (self.fill[number], number, self.version[number], parts))
            self.some[1] |= 1 << size

    def _emptiest(self, kind: int, size: int, but: int):
        """The emptiest bin, ``but`` one, that has such a parcel now; None if there is none."""
        heap, aside = self.heaps[kind][size], None
        while heap and (self.version[heap[0][1]] != heap[0][2] or heap[0][1] == but):
            entry = heappop(heap)
            if self.version[entry[1]] == entry[2]:
                aside = entry
        found = heap[0] if heap else None
        if aside:
            heappush(heap, aside)
        elif not heap:
            self.some[kind] &= ~(1 << size)
        return found

    def _gain(self, number: int) -> bool:
        """The best exchange that makes bin ``number`` fuller at the cost of an emptier one; False if there is none."""
        fill, room = self.fill[number], self.room
        single, pairs = self._parcels(number)
        offers = [(0, (), (0, 1)), *((s, (s,), (0, 1)) for s in single), *((s, p, (0,)) for s, p in pairs.items())]
        best = None
        for gives, given, kinds in offers:
            for kind in kinds:
                # From the size that fills the bin down: the first emptier partner is the best for this offer.
                least = gives + (best[0] if best else 0)
                window = self.some[kind] & ((1 << (gives + room - fill + 1)) - 1)
                while window:
                    size = window.bit_length() - 1
                    if size <= least:
                        break
                    other = self._emptiest(kind, size, number)
                    if other and other[0] < fill + size - gives:
                        best = (size - gives, given, other)
                        break
                    window &= ~(1 << size)
        if not best:
            return False
        _, given, (_, donor, _, taken) = best
        self._trade(number, donor, given, taken)
        return True

    def _take(self, number: int, parts: tuple[int, ...]) -> list[int]:
        out = []
        for size in parts:
            at = next(k for k, i in enumerate(self.bins[number]) if self.sizes[i] == size)
            out.append(self.bins[number].pop(at))
        return out

    def _trade(self, number: int, donor: int, given: tuple[int, ...], taken: tuple[int, ...]) -> None:
        come, go = self._take(donor, taken), self._take(number, given)
        self.bins[number] += come
        self.bins[donor] += go
        for n, change in ((number, sum(taken) - sum(given)), (donor, sum(given) - sum(taken))):
            self.fill[n] += change
            self.version[n] += 1
            self._offer(n)

    def run(self) -> list[list[int]]:
        """Bins at a local optimum, empty ones left out: the sum of squared fills is whole, bounded and grows with each step."""
        waiting = [(-f, n) for n, f in enumerate(self.fill) if 0 < f < self.room]
        waiting.sort()
        changed = True
        while changed:
            changed = False
            for _, number in waiting:
                while 0 < self.fill[number] < self.room and self._gain(number):
                    changed = True
            waiting = sorted((-self.fill[n], n) for _, n in waiting if 0 < self.fill[n] < self.room)
        return [b for b in self.bins if b]


def pack(sizes: list[int], bins: list[list[int]] | None, room: int) -> list[list[int]]:
    """Bins of the pieces with these sizes: from ``bins`` on, or from a best fit."""
    return Search(sizes, bins if bins is not None else best_fit(sizes, room), room).run()


# ---------------------------------------------------------------- groups


def _packed(how: Packing, round_: int):
    """One group, packed: each piece gets its bin, its place there, and whether the bin is full."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group.column("length").to_pylist()
        bins = None
        if round_:
            held: dict[int, list[int]] = {}
            for at, number in enumerate(group.column("sequence_id").to_pylist()):
                held.setdefault(number, []).append(at)
            bins = list(held.values())
        number, offset, full = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        first = (round_ << 32 | group.column("group")[0].as_py()) << 20
        for local, members in enumerate(pack(sizes, bins, how.room)):
            place = 0
            for at in members:
                number[at], offset[at] = (first | local) << 1 | 1, place
                place += sizes[at]
            full[members] = place == how.room
        columns = [group.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        columns += [pa.array(number), pa.array(offset), pa.array(full)]
        return pa.table(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "full"])

    return run


PACKED = f"{PIECES}, sequence_id bigint, offset bigint, full boolean"


def _round(rows: DataFrame, groups: int, key: str, how: Packing, round_: int) -> DataFrame:
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return store(dealt.groupBy("group").applyInArrow(_packed(how, round_), PACKED))


def sequences(docs: DataFrame, how: Packing) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs`` (doc_id, text).

    A null text is empty and gives one piece, the end id alone. Repeated rows are packed as often as they
    come, a null doc_id is carried, other columns are ignored; an empty table gives none. The number of tasks
    follows the number of pieces; a group holds about ``how.group`` of them, dealt by number and not by content.
    """
    rows = documents(docs, "doc_id", "text").mapInArrow(_pieces(how), PIECES)
    pieces = store(rows.withColumn("row", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == how.room)
    whole = whole.withColumn("sequence_id", F.shiftleft("row", 1)).withColumn("offset", F.lit(0).cast("long"))
    left, key = pieces.where(F.col("length") < how.room), "row"
    done, round_, count = [whole], 0, left.count()
    while count:
        groups = max(1, -(-count // how.group))
        packed = _round(left, groups, key, how, round_)
        left, key = packed.where("NOT full"), "sequence_id"
        before, count = count, left.count()
        if groups == 1 or (round_ and count > 0.9 * before):
            done.append(packed)
            break
        done.append(packed.where("full"))
        round_ += 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = done[0].select(columns)
    for part in done[1:]:
        out = out.union(part.select(columns))
    return out
