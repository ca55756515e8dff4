"""Ranked lexical search over deduplicated bags of words.

Only an item's own terms and a document's length class ``m`` enter its score, so documents are restricted to
the vocabulary of the items: what is left of one is its bag (term numbers and counts) and m. Documents with
equal bags and equal m are a class, hashed for the shuffle and told apart by the bags themselves; a class is scored
once, and only classes among an item's best are expanded to their members, by ascending doc_id.

Items are taken in chunks of bounded vocabulary, each a pass over the documents, so what a task holds does
not grow with the number of items.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import blocks, documents, spread, store, utf8
from trackweave.session import settle_small

# Bytes that part terms become spaces, and A-Z small; bytes from 80 on belong to letters outside ASCII.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
# Bytes of a long text that are split at once.
PIECE = 1 << 20
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Ranking:
    """``top`` documents an item; ``chunk``: bytes of item texts a pass over the documents takes."""

    top: int = 10
    chunk: int = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size."""
    if len(text) <= PIECE:
        yield text.translate(FOLD).split()
        return
    start = 0
    while start < len(text):
        part = text[start : start + PIECE].translate(FOLD)
        # A term that reaches over the end of this piece belongs to the next, unless it fills the piece.
        end = len(part) if start + PIECE >= len(text) else part.rfind(b" ") + 1
        if not end:
            found = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]").search(text, start + PIECE)
            end = found.start() - start if found else len(text) - start
            part = text[start : start + end].translate(FOLD)
        yield part[:end].split()
        start += end


@dataclass(frozen=True)
class Chunk:
    """Items with their vocabulary: ``uses[t]`` are the items (numbers) that hold term t and how often."""

    ids: list
    vocabulary: dict[bytes, int]
    uses: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Chunk:
        vocabulary: dict[bytes, int] = {}
        uses: list[tuple[list[int], list[int]]] = []
        for number, (_, text) in enumerate(rows):
            counts = Counter(t for part in terms((text or "").encode()) for t in part)
            for term, count in counts.items():
                at = vocabulary.setdefault(term, len(vocabulary))
                if at == len(uses):
                    uses.append(([], []))
                uses[at][0].append(number)
                uses[at][1].append(count)
        return cls([i for i, _ in rows], vocabulary, [(np.array(i), np.array(c)) for i, c in uses])


def bag(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, bytes | None]:
    """Terms of a text, with repeats, and its bag: (term number, count) pairs in order; None without such a term."""
    n = 0
    counts: Counter[int] = Counter()
    for part in terms(text):
        n += len(part)
        counts.update(vocabulary[t] for t in part if t in vocabulary)
    if not counts:
        return n, None
    pairs = np.array(sorted(counts.items()), np.int64)
    return n, pairs.tobytes()


def pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _bags(chunk):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = chunk.value.vocabulary
        for block in blocks(batches, "text"):
            n, bags = zip(*(bag(text, vocabulary) for text in utf8(block.column("text"))))
            yield pa.record_batch([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the number of documents that hold each term."""
    held = np.zeros(0, np.int64)
    for batch in batches:
        found = [pairs(raw)[0] for raw in batch.column("bag").to_pylist()]
        if found:
            counts = np.bincount(np.concatenate(found), minlength=len(held))
            counts[: len(held)] += held
            held = counts
    some = np.flatnonzero(held)
    yield pa.record_batch([pa.array(some), pa.array(held[some])], ["term", "df"])


def _scored(chunk, weights, top: int):
    """The best classes of a task's share for each item, by falling score, then by their first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, w = chunk.value.uses, weights.value
        items = len(chunk.value.ids)
        best: list[list[tuple[int, int, int, int, bytes]]] = [[] for _ in range(items)]
        least = np.ones(items, np.int64)  # scores below can no longer enter
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("first", "hash", "m", "bag")]
            for first, key, m, raw in zip(*columns):
                numbers, counts = pairs(raw)
                parts = w[numbers] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))
                score = np.zeros(items, np.int64)
                for t, part in zip(numbers.tolist(), parts.tolist()):
                    if part:
                        score[uses[t][0]] += uses[t][1] * part
                entry = (LAST if first is None else first, key, m, raw)
                for item in np.flatnonzero(score >= least).tolist():
                    held = best[item]
                    held.append((-int(score[item]), *entry))
                    if len(held) >= 4 * top:
                        held.sort()
                        del held[top:]
                        least[item] = max(1, -held[-1][0])
        rows = [(item, -s, first, key, m, raw) for item, held in enumerate(best) for s, first, key, m, raw in sorted(held)[:top]]
        for start in range(0, len(rows), 1000):
            item, score, first, key, m, raw = zip(*rows[start : start + 1000])
            columns = [pa.array(c, pa.int64()) for c in (item, score, first, key, m)]
            yield pa.record_batch([*columns, pa.array(raw, pa.binary())], ["item", "score", "first", "hash", "m", "bag"])

    return run


def _top(df: DataFrame, keys: list[str], order: list, limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each key; Spark cuts every task's share before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def _ranked(docs: DataFrame, rows: list, how: Ranking) -> DataFrame:
    """The ranking of one chunk of items."""
    context = docs.sparkSession.sparkContext
    chunk = context.broadcast(Chunk.of(rows))
    found = store(docs.mapInArrow(_bags(chunk), "doc_id bigint, n bigint, bag binary"))
    total = found.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    some = found.where("bag IS NOT NULL")
    counted = some.select("bag").mapInArrow(_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(chunk.value.vocabulary), np.int64)
    for term, df in counted.collect():  # as many as the chunk has terms
        weights[term] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df + 1)))
    weights = context.broadcast(weights)

    m = F.expr(f"25 + (75 * n * {total.docs}L) div {total.terms or 1}L")
    kept = some.select("doc_id", m.alias("m"), "bag").withColumn("hash", F.xxhash64("bag", "m"))
    classes = kept.groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("first"))
    schema = "item bigint, score bigint, first bigint, hash bigint, m bigint, bag binary"
    scored = classes.mapInArrow(_scored(chunk, weights, how.top), schema)
    best = store(_top(scored, ["item"], [F.desc("score"), F.asc("first"), F.asc("hash"), F.asc("bag")], how.top))

    # Only the winners' members are looked for: at most top classes for each item.
    key = ["hash", "m", "bag"]
    named = store(best.select(*key).distinct().withColumn("class", F.monotonically_increasing_id()))
    members = kept.join(settle_small(named), key).select("class", "doc_id")
    # In two steps, so that a class of any size meets in many tasks first.
    order = [F.asc_nulls_last("doc_id")]
    members = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(spread(docs))))
    members = _top(_top(members, ["class", "part"], order, how.top), ["class"], order, how.top)
    pairs_ = best.select("item", "score", *key).join(named, key).select("item", "score", "class")
    ranked = _top(pairs_.join(members.select("class", "doc_id"), "class"), ["item"], [F.desc("score"), *order], how.top)
    names = docs.sparkSession.createDataFrame([(i, item) for i, item in enumerate(chunk.value.ids)], "item bigint, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, how: Ranking = Ranking()) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``how.top`` best documents with a score above 0.

    ``docs`` (doc_id, text), ``items`` (item_id, text). Null and empty texts have no terms: such documents count for
    nothing, such items get no rows. Equal scores stand by ascending doc_id, null last. Repeated rows are documents
    of their own, and repeated items are ranked as often; an item_id may be null. Other columns are ignored. Either
    table empty: no rows.
    """
    docs = documents(docs, "doc_id", "text")
    sized = store(documents(items, "item_id", "text").where("octet_length(text) > 0"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-total // how.chunk)
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, chunks))))
    dealt = store(dealt.repartition(max(1, min(chunks, spread(docs))), "chunk").sortWithinPartitions("chunk"))
    out = None
    for number in range(chunks):
        rows = dealt.where(F.col("chunk") == number).select("item_id", "text").collect()  # about how.chunk bytes
        if rows:
            part = _ranked(docs, [tuple(r) for r in rows], how)
            out = part if out is None else out.union(part)
    if out is None:
        return items.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out
