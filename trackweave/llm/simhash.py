"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint word of 64 bits is cut into four segments of 16 bits. With at most three wrong
bits one segment is right, and of the two 23-bit halves of the other 48 bits one has at most
one wrong bit (pigeonhole). A key is an exact segment with a codeword near one of the halves:
words that differ in up to three bits always share a key. Keys meet by a shuffle, and members of
a bucket are linked where their whole fingerprints are near enough.

Only distinct fingerprints get keys, so exact copies cost one row. A bucket sends on a spanning
forest of its links (at most one row for each member), never its pairs; a bucket beyond
``GROUP`` members is dealt out as pairs of chunks.

``keep_one`` asks for similarity of shingle sets: pairs whose fingerprints of these sets are near, found in the same way, and
pairs that meet by keys of MinHash bands, for those whose fingerprints lie farther apart, are all checked on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trackweave.llm.common import blocks, documents, spread, store, utf8
from trackweave.llm.golay import near_codewords
from trackweave.session import settle_small

SEED = 42
# Members of a bucket that one task compares at once: a megabyte or two, some seconds.
GROUP = 1 << 16
# MinHash keys of a text; as many buckets is it a member of.
BANDS = 24


@dataclass(frozen=True)
class Near:
    """What counts as near.

    ``checked``: words in a shingle and 64-bit words of the fingerprint that is compared;
    ``radius``: bits in which two of them may differ (3: all links are found).
    """

    checked: tuple[int, int] = (3, 1)
    radius: int = 3


@dataclass(frozen=True)
class Similar:
    """Texts whose sets of ``words``-word shingles have at least this Jaccard ``similarity``."""

    similarity: float = 0.8
    words: int = 5

    def near(self, common, one, other):
        """Whether ``common`` of ``one`` and ``other`` distinct shingles are enough; 0.8 is met by 4 of 5."""
        return common + 1e-9 >= self.similarity * (one + other - common)


def similar_texts(similarity: float = 0.8, words: int = 5) -> Similar:
    """Near fingerprints and MinHash keys propose such pairs; every link is checked on the whole sets of shingles."""
    return Similar(similarity, words)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every shingle of the lower-cased words; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of each hash (word 0: the hash itself), by a finalising mix."""
    if word == 0:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document (``counts`` hashes each, in order) the 64 bits set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # Eight bits of a hash are counted at once in eight byte lanes, in pieces of up to 255 hashes.
    starts = np.cumsum(counts) - counts
    pieces = (counts[full] + 254) // 255
    owner = np.repeat(np.arange(len(full)), pieces)
    first = np.cumsum(pieces) - pieces
    at = starts[full][owner] + 255 * (np.arange(len(owner)) - first[owner])
    bits = np.empty((len(full), 8, 8), bool)
    half = counts[full]
    for b in range(8):
        lanes = (hashes >> np.uint64(b)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, :, b] = 2 * np.add.reduceat(sums, first, axis=0) > half[:, None]
    out[full] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(texts: list[bytes], shingle: int, words: int) -> np.ndarray:
    """SimHash of each text, shape (texts, words)."""
    each = [shingle_hashes(text, shingle) for text in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    hashes = np.fromiter((h for hs in each for h in hs), np.uint64, int(counts.sum()))
    return np.stack([majority(_mixed(hashes, w), counts) for w in range(words)], axis=1)


def _binary(words: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as binary values, most significant byte first."""
    return pa.array([row.tobytes() for row in words.astype(">u8")], pa.binary())


def _words(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(column), -1)


def _fingerprinted(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            prints = _binary(fingerprints(utf8(block.column("text")), *near.checked))
            columns = [block.column("doc_id"), block.column("text_hash"), prints]
            yield pa.record_batch(columns, ["doc_id", "text_hash", "checked"])

    return run


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as hashes in order."""
    return [np.unique(np.array(shingle_hashes(text, size), np.uint64)) for text in texts]


def band_rows(near: Similar) -> int:
    """Minima in a key, as many as let a pair at the required similarity miss all keys once in 10,000 times at most."""
    rows = 1
    while rows < 16 and (1 - near.similarity ** (rows + 1)) ** BANDS <= 1e-4:
        rows += 1
    return rows


def band_keys(sets: list[np.ndarray], near: Similar) -> np.ndarray:
    """MinHash keys of each set, shape (sets, BANDS); a set without shingles has zeros.

    Two sets agree in one minimum with a chance equal to their Jaccard similarity, wherever they differ.
    """
    rows = band_rows(near)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    out = np.zeros((len(sets), BANDS), np.uint64)
    if not len(full):
        return out
    hashes = np.concatenate([sets[i] for i in full])
    sizes = np.array([len(sets[i]) for i in full])
    starts = np.cumsum(sizes) - sizes
    salts = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, rows, 2), np.uint64)
    moved = np.empty_like(hashes)
    for band in range(BANDS):
        key = np.full(len(full), band, np.uint64)
        for row in range(rows):
            np.bitwise_xor(hashes, salts[band, row, 0], out=moved)
            np.multiply(moved, salts[band, row, 1] * np.uint64(2) + np.uint64(1), out=moved)
            key = _mixed(key ^ np.minimum.reduceat(moved, starts), row + 1)
        out[full, band] = key
    return out


def _sketch(block: pa.RecordBatch, sets: list[np.ndarray], near: Similar) -> pa.RecordBatch:
    nodes = np.fromiter((xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
    ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
    keys = pa.ListArray.from_arrays(ends, pa.array(band_keys(sets, near).view(np.int64).ravel()))
    columns = [block.column("doc_id"), block.column("text_hash"), pa.array(nodes), keys]
    return pa.record_batch(columns, ["doc_id", "text_hash", "node", "keys"])


def _sketched(near: Similar):
    """Node (hash of the set of shingles) and keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield _sketch(block, shingle_sets(utf8(block.column("text")), near.words), near)

    return run


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set of shingles, shape (sets, 1)."""
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    return majority(np.concatenate([np.empty(0, np.uint64), *sets]), counts)[:, None]


def _printed(near: Similar):
    """What ``_sketched`` gives, and the fingerprint of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = shingle_sets(utf8(block.column("text")), near.words)
            yield _sketch(block, sets, near).append_column("checked", _binary(set_prints(sets)))

    return run


def _set_rows(near: Similar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = shingle_sets(utf8(block.column("text")), near.words)
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            columns = [block.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.record_batch(columns, ["node", "grams"])

    return run


def document_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of fingerprint words, shape (n, words): (row numbers, keys)."""
    rows, keys = [], []
    numbers = np.arange(len(words))
    for w in range(words.shape[1]):
        for segment in range(4):
            shift = np.uint64(16 * segment)
            exact = (words[:, w] >> shift) & np.uint64(0xFFFF)
            low = words[:, w] & np.uint64((1 << 16 * segment) - 1)
            rest = low | (words[:, w] >> (shift + np.uint64(16)) << shift if segment < 3 else np.uint64(0))
            for half in range(2):
                near = near_codewords((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF))
                tag = np.int64((w * 4 + segment) * 2 + half) << 28
                key = tag | (exact.astype(np.int64) << 12)[:, None] | near
                there = near >= 0
                rows.append(np.broadcast_to(numbers[:, None], near.shape)[there])
                keys.append(key[there])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            rows, keys = document_keys(_words(part.column("routed")))
            yield pa.record_batch([pa.array(keys), part.column("node").take(pa.array(rows))], ["key", "node"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``names``: a batch's last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(n)) for n in names]
        last = np.logical_and.reduce([c == c[-1] for c in columns])
        begun = 0 if last.all() else batch.num_rows - int(np.argmin(last[::-1]))
        same = held and all(held[0].column(n)[0].as_py() == c[0] for n, c in zip(names, columns))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if begun:
            yield pa.Table.from_batches([*held, batch.slice(0, begun)])
            held = []
        held.append(batch.slice(begun))
    if held:
        yield pa.Table.from_batches(held)


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key occurs again; rows come sorted by key, so only a batch's ends need care."""
    key = node = None  # the last row, if it is not known yet whether its key recurs
    for batch in batches:
        keys, nodes = np.asarray(batch.column("key")), np.asarray(batch.column("node"))
        if not len(keys):
            continue
        if key is not None:
            keys, nodes = np.concatenate([key, keys]), np.concatenate([node, nodes])
        equal = keys[1:] == keys[:-1]
        again = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        if key is not None:
            again[0] |= known
        # The last row is decided with the next batch.
        yield pa.record_batch([pa.array(keys[:-1][again[:-1]]), pa.array(nodes[:-1][again[:-1]])], ["key", "node"])
        key, node, known = keys[-1:], nodes[-1:], bool(again[-1])
    if key is not None and known:
        yield pa.record_batch([pa.array(key), pa.array(node)], ["key", "node"])


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node get the first node of their key as ``hub``."""
    key = hub = None
    for batch in batches:
        keys, nodes = np.asarray(batch.column("key")), np.asarray(batch.column("node"))
        if not len(keys):
            continue
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        first = nodes[starts]
        if key == keys[0]:
            first[0] = hub
        yield pa.record_batch([pa.array(keys), pa.array(nodes), pa.array(np.repeat(first, np.diff([*starts, len(keys)])))], ["key", "node", "hub"])
        key, hub = keys[-1], first[-1]


def forest(prints: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links (differing bits <= radius) between rows of 64-bit words."""
    left = np.arange(len(prints))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1) <= radius
            for other in left[near]:
                yield int(at), int(other)
            frontier.extend(left[near].tolist())
            left = left[~near]


def _linked(radius: int, names: list[str], limit: int):
    """Links within the groups of ``names``; members of a group beyond ``limit`` come out as they are, with b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            a, b, key = zip(*rows) if rows else ((), (), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], ["a", "b", "key"])

        for whole in _groups(batches, names):
            columns = [np.asarray(whole.column(n)) for n in names]
            nodes, prints = np.asarray(whole.column("node")), _words(whole.column("checked"))
            changed = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            starts = np.concatenate([[0], changed])
            sizes = np.diff(np.concatenate([starts, [len(nodes)]]))
            two = starts[sizes == 2]
            near = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1) <= radius]
            rows = list(zip(nodes[near].tolist(), nodes[near + 1].tolist(), [None] * len(near)))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if n > limit:
                    rows.extend((node, None, int(columns[0][s])) for node in nodes[s : s + n].tolist())
                else:
                    rows.extend((int(nodes[s + i]), int(nodes[s + j]), None) for i, j in forest(prints[s : s + n], radius))
            yield out(rows)

    return run


def links(nodes: DataFrame, radius: int, limit: int = GROUP) -> DataFrame:
    """(a, b): links that connect ``nodes`` (node, checked, routed) as all their links would."""
    count = spread(nodes)
    keys = nodes.select("node", "routed").mapInArrow(_keyed, "key bigint, node bigint")
    crowd = store(keys.repartition(count, "key").sortWithinPartitions("key").mapInArrow(_crowded, "key bigint, node bigint"))
    prints = nodes.select("node", "checked")
    members = crowd.join(prints, "node").repartition(count, "key").sortWithinPartitions("key", "node")
    found = store(members.mapInArrow(_linked(radius, ["key"], limit), "a bigint, b bigint, key bigint"))
    pairs = found.where("b IS NOT NULL").select("a", "b")
    large = found.where("b IS NULL").select("key", F.col("a").alias("node"))
    # Chunks of a large bucket meet two by two: each member goes to every pair its chunk is part of.
    chunks = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(limit / 2)).cast("int").alias("n"))
    own = F.pmod(F.hash("node"), F.col("n"))
    dealt = large.join(chunks, "key").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node")
    group = ["key", "low", "high"]
    met = dealt.join(prints, "node").repartition(count, *group).sortWithinPartitions(*group, "node")
    more = met.mapInArrow(_linked(radius, group, 1 << 62), "a bigint, b bigint, key bigint").select("a", "b")
    return pairs.union(more).distinct()


def _verified(near: Similar):
    """Links (a, b) between hubs ``b`` and members ``a`` whose sets of shingles are similar enough.

    Rows (b, part, node, grams) come by hub and part, the hub's own set first: one set is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for batch in batches:
            grams, rows = batch.column("grams"), []
            for i, (b, node) in enumerate(zip(batch.column("b").to_pylist(), batch.column("node").to_pylist())):
                if node == b:
                    hub, own = b, np.array(grams[i].values)
                    continue
                assert hub == b
                other = np.asarray(grams[i].values)
                # Sets of very different sizes cannot be similar.
                if near.near(min(len(own), len(other)), len(own), len(other)):
                    if near.near(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other)):
                        rows.append((node, b))
            a, b = zip(*rows) if rows else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _checked_with_hubs(pairs: DataFrame, sets: DataFrame, near: Similar, members: int) -> DataFrame:
    """Those of ``pairs`` (a, hub b) that are similar: a hub's set is sent once for each ``members`` of its members."""
    count = spread(pairs)
    hubs = store(pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(members)).cast("int").alias("parts")))
    dealt = pairs.join(hubs, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node"))
    own = hubs.select("b", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("b").alias("node"))
    rows = dealt.union(own).join(sets, "node").repartition(count, "b", "part")
    rows = rows.sortWithinPartitions("b", "part", F.col("node") != F.col("b"))
    return rows.select("b", "node", "grams").mapInArrow(_verified(near), "a bigint, b bigint")


def set_forest(sets: list[np.ndarray], roots: np.ndarray, near: Similar) -> Iterator[tuple[int, int]]:
    """Links between ``sets`` that connect them as all pairs' would; equal ``roots`` are connected already."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(ids), bool)
    left = np.ones(len(sets), bool)
    for begin in range(len(sets)):
        if not left[begin]:
            continue
        frontier = np.flatnonzero(left & (roots == roots[begin])).tolist()
        left[frontier] = False
        while frontier and left.any():
            at = frontier.pop()
            own = ids[starts[at] : starts[at] + sizes[at]]
            # Sets of very different sizes cannot be similar.
            rest = np.flatnonzero(left & near.near(np.minimum(sizes, sizes[at]), sizes, sizes[at]))
            if not len(rest):
                continue
            mark[own] = True
            cut = np.concatenate([[0], np.cumsum(sizes[rest])])
            places = np.arange(cut[-1]) + np.repeat(starts[rest] - cut[:-1], sizes[rest])
            common = np.add.reduceat(mark[ids[places]], cut[:-1], dtype=np.int64)
            mark[own] = False
            for other in rest[near.near(common, sizes[rest], sizes[at])].tolist():
                yield at, other
                if left[other]:
                    joined = np.flatnonzero(left & (roots == roots[other]))
                    left[joined] = False
                    frontier.extend(joined.tolist())


def _met(near: Similar, names: list[str]):
    """Links within the groups of ``names``, found on whole sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, names):
            columns = [np.asarray(whole.column(n)) for n in names]
            nodes, roots = np.asarray(whole.column("node")), np.asarray(whole.column("root"))
            grams = whole.column("grams")
            changed = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            starts = [0, *changed.tolist(), len(nodes)]
            rows = []
            for s, e in zip(starts, starts[1:]):
                if e - s > 1 and (roots[s:e] != roots[s]).any():
                    sets = [np.asarray(grams[i].values) for i in range(s, e)]
                    rows.extend((int(nodes[s + i]), int(nodes[s + j])) for i, j in set_forest(sets, roots[s:e], near))
            a, b = zip(*rows) if rows else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_prints(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that connect those whose fingerprints ``checked`` differ in three bits or fewer.

    One node of each fingerprint stands for it; the others with that fingerprint are paired with it.
    """
    nodes = store(prints.select("node", "checked").distinct())
    first = store(nodes.groupBy("checked").agg(F.min("node").alias("least")))
    same = nodes.join(first, "checked").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    kinds = first.select(F.col("least").alias("node"), "checked", F.col("checked").alias("routed"))
    return links(kinds, Near().radius).union(same)


def _similar_links(docs: DataFrame, prints: DataFrame, near: Similar, limit: int, proposed: DataFrame | None = None) -> DataFrame:
    """(a, b): links between nodes that connect them as all similar pairs within buckets would.

    Each member of a bucket is first checked against the bucket's hub, and pairs ``proposed`` (a, b) with them, every such pair once. Buckets
    whose members are then not all connected get the members' sets, dealt out as pairs of chunks of about
    ``limit`` shingles.
    """
    count = spread(prints)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    classes = store(prints.groupBy("node").agg(F.min(order).alias("first"), F.first("keys").alias("keys")))
    keys = classes.select(F.explode("keys").alias("key"), "node")
    crowd = keys.repartition(count, "key").sortWithinPartitions("key", "node").mapInArrow(_crowded, "key bigint, node bigint")
    crowd = store(crowd.mapInArrow(_hubs, "key bigint, node bigint, hub bigint"))
    pairs = crowd.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    met = crowd.select("node")
    if proposed is not None:
        pairs = pairs.union(proposed.select(F.greatest("a", "b"), F.least("a", "b")))
        met = met.union(proposed.select("a")).union(proposed.select("b"))
    wanted = classes.join(met.distinct(), "node", "left_semi")
    wanted = settle_small(wanted.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")))
    met = docs["doc_id"].eqNullSafe(wanted["_id"]) & (F.xxhash64(docs["text"]) == wanted["_hash"])
    texts = docs.join(wanted, met).select("node", "text")
    sets = store(texts.mapInArrow(_set_rows(near), "node bigint, grams array<bigint>").dropDuplicates(["node"]))
    found = store(_checked_with_hubs(store(pairs.distinct()), sets, near, MEMBERS))

    sizes = sets.select("node", F.size("grams").alias("size"))
    rooted = crowd.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = store(rooted.join(sizes, "node").select("key", "node", "root", "size"))
    # The only pair of a bucket of two has been checked.
    buckets = rooted.groupBy("key").agg(
        F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("all")
    )
    chunks = buckets.where("members > 2 AND low <> high").select("key", F.ceil(F.col("all") / F.lit(limit)).cast("int").alias("n"))
    own = F.pmod(F.hash("node"), F.col("n"))
    dealt = rooted.join(chunks, "key").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "root")
    group = ["key", "low", "high"]
    met = dealt.join(sets, "node").repartition(count, *group).sortWithinPartitions(*group, "node")
    return found.union(met.mapInArrow(_met(near, group), "a bigint, b bigint")).distinct()


# Shingles of the members of a bucket that one task compares at once, by chunk: 4 MB.
SHINGLES = 1 << 19
# Members of a hub that one task checks.
MEMBERS = 256


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): each linked node with the smallest node it is connected to.

    Alternates two contractions (links to larger neighbours, then links to smaller ones move to
    the smallest neighbour) until nothing changes; every round is written to shared storage.
    """

    def same(one: DataFrame, other: DataFrame) -> bool:
        """Whether two sets of links are equal: as many, and none that the other lacks."""
        return one.count() == other.count() and other.join(one, ["a", "b"], "left_anti").isEmpty()

    def both(df: DataFrame) -> DataFrame:
        return df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def contract(df: DataFrame, up: bool) -> DataFrame:
        """Each node's larger (``up``) or smaller neighbours move to the smallest of its neighbours and itself."""
        seen = df if not up else both(df)
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        joined = seen.join(least, "a")
        if up:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        return moved.where("a <> b").distinct()

    # From the larger node to the smaller.
    now = store(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while before is None or not same(before, now):
        before, now = now, store(contract(contract(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _named(docs: DataFrame, near: Near) -> DataFrame:
    """(doc_id, text_hash, checked, root, component_id) for every row; ``root`` is the component itself."""
    texts = documents(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    prints = store(texts.mapInArrow(_fingerprinted(near), "doc_id bigint, text_hash bigint, checked binary"))
    # XXH64 maps distinct 8-byte values to distinct numbers: exact for a one-word fingerprint.
    node = F.xxhash64("checked")
    classes = prints.groupBy("checked").agg(F.min("doc_id").alias("least"))
    classes = store(classes.withColumn("node", node))
    found = components(links(classes.withColumn("routed", F.col("checked")), near.radius))
    rooted = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(whole, "root").select("node", "root", "component_id")
    # The copies of one text may be a third of all rows: the adaptive skew join splits them.
    return prints.withColumn("node", node).join(names, "node", "left")


def _similar(docs: DataFrame, near: Similar) -> DataFrame:
    """(doc_id, text_hash, root) for every row; ``root`` names the component."""
    rows = documents(docs, "doc_id", "text")
    texts = rows.withColumn("text_hash", F.xxhash64("text"))
    columns = "doc_id bigint, text_hash bigint, node bigint, keys array<bigint>, checked binary"
    prints = store(texts.mapInArrow(_printed(near), columns))
    found = components(_similar_links(rows, prints, near, SHINGLES, store(near_prints(prints))))
    return prints.join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id among all documents reachable over links, itself
    included. A null text is empty; texts without words have fingerprint zero and are linked like
    any other. Repeated rows come out as often; a null doc_id is carried, and names a component
    only if all its rows have none. An empty table gives none.
    """
    return _named(docs, near).select("doc_id", F.lower(F.hex("checked")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, near: Similar) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near-duplicates, all columns kept.

    The row with the smallest doc_id stays (null last; among equal ones the smallest text hash); of
    rows that are equal in doc_id and text one stays. Only the decisions are joined to the texts.
    """
    named = store(_similar(docs, near))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kinds = named.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = kinds.groupBy("root").agg(F.min(order).alias("first"))
    stays = order.eqNullSafe(F.col("first")).alias("stays")
    decided = kinds.join(first, "root").select("doc_id", "text_hash", "rows", stays)
    special = store(decided.where("NOT stays OR rows > 1"))
    moved = settle_small(special.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    again = settle_small(
        special.where("stays").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    )

    def met(keys: DataFrame):
        return docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_hash"])

    rest = docs.join(moved, met(moved), "left_anti")
    return rest.unionByName(docs.join(again, met(again), "left_semi").dropDuplicates(["doc_id", "text"]))
