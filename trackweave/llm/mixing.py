"""Mixing sources to target weights by temperature.

Weights are the sources' token shares to the power of an exponent, normalised. The exponent is
bisected until the weights have a target entropy, or until no source is repeated more often than a
limit. The weights are then realised exactly: each source goes round its documents in a keyed
order (a new permutation each epoch) until its token budget is spent, and what it gives is dealt to
blocks, every block holding each source in its share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import documents, store

# Bits of a key that name its slice: running totals go over slices, so no task sorts a whole source.
SLICE_BITS = 12


@dataclass(frozen=True)
class Target:
    """``entropy``: share of the largest entropy (equal weights) that the weights must reach; or
    ``repeats``: epochs that no source may exceed. ``budget``: tokens to give, as a multiple of the corpus;
    None: as many as let every source be used whole at least once. ``blocks``: parts of the result.
    """

    repeats: float | None = 4.0
    entropy: float | None = None
    budget: float | None = None
    blocks: int = 64
    seed: int = 42


def exponent_for(sums: DataFrame, total: int, target: Target) -> float:
    """The exponent in 0..1 that is nearest to equal weights (0) under the limit, or meets the entropy.

    ``sums`` has the tokens of each source. One aggregate tries 15 exponents, which is four steps of
    bisection; no source leaves the table.
    """
    share = F.col("tokens") / F.lit(float(total))

    def measures(a: float) -> list:
        raw = F.pow(share, F.lit(a))
        return [F.sum(raw), F.sum(raw * F.log(raw)), F.min(raw / share), F.max(raw / share)]

    def too_flat(norm: float, logs: float, least: float, most: float, count: int) -> bool:
        if target.entropy is not None:
            return math.log(norm) - logs / norm > target.entropy * math.log(max(count, 1))
        scale = target.budget if target.budget is not None else norm / least
        return most / norm * scale > target.repeats

    low, high, inner = 0.0, 1.0, 15
    for _ in range(8):
        tried = [low + (high - low) * i / (inner + 1) for i in range(inner + 1)]
        row = sums.where("tokens > 0").agg(F.count("*"), *[m for a in tried for m in measures(a)]).first()
        flat = [too_flat(*row[1 + 4 * i : 5 + 4 * i], row[0]) for i in range(len(tried))]
        if not flat[0]:
            return low
        last = max(i for i, f in enumerate(flat) if f)
        low, high = tried[last], tried[last + 1] if last < inner else high
    return high


def source_weights(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """(source, docs, tokens, share, weight, epochs, quota): one row per source of ``docs`` (source, tokens)."""
    sums = store(docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    exponent = exponent_for(sums, total, target) if total else 1.0
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    raw = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent))).otherwise(0.0)
    norm, least = sums.agg(F.sum(raw), F.min(F.when(F.col("tokens") > 0, raw / share))).first()
    weight = raw / F.lit(norm or 1.0)
    scale = target.budget if target.budget is not None else (norm or 1.0) / (least or 1.0)
    rate = F.when(F.col("tokens") > 0, weight / share * F.lit(float(scale))).otherwise(1.0)
    columns = {"share": share, "weight": weight, "epochs": rate, "quota": F.round(rate * F.col("tokens"), 3)}
    return sums.select("source", "docs", "tokens", *[c.alias(name) for name, c in columns.items()])


def mix(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """(doc_id, source, tokens, epoch, block, order_key): every use of every document, one row each.

    Within an epoch a source's documents follow a keyed order; the last epoch stops where the quota of
    tokens is reached (the document that crosses it is the last one used). ``block`` deals the uses out
    in that order, each block having its part of every source; within a block order by ``order_key``.
    Tokens are white-space words. A null text has none: such documents are used once, in epoch 0. A null
    source is a source of its own, repeated rows are uses of their own, an empty table gives none. Other columns are
    ignored.
    """
    return _uses(docs, target).drop("text_hash")


def mixed_texts(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """``mix`` with the text of each use: (doc_id, source, tokens, epoch, block, order_key, text).

    Texts are joined by doc_id and hash of the text, so rows that share a doc_id keep their own; nulls, repeated rows,
    empty tables and other columns as in ``mix``. Texts are shuffled once, however often they are used.
    """
    uses = store(_uses(docs, target))
    texts = documents(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    if not texts.groupBy(*key).count().where("count > 1").isEmpty():
        order = Window.partitionBy(*key).orderBy("text")
        texts = texts.withColumn("_copy", F.row_number().over(order)).where("_copy = 1")
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "text")
    met = uses["doc_id"].eqNullSafe(texts["_id"]) & (uses["text_hash"] == texts["_hash"])
    return uses.join(texts, met).drop("text_hash", "_id", "_hash")


def _uses(docs: DataFrame, target: Target) -> DataFrame:
    texts = documents(docs, "doc_id", "source", "text").withColumn("text_hash", F.xxhash64("text"))
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", -1), ""))
    rows = store(texts.select("doc_id", "text_hash", "source", words.cast("bigint").alias("tokens")))
    quotas = store(source_weights(rows, target)).withColumnRenamed("tokens", "source_tokens")
    # Whole epochs need no order; a use per document and epoch.
    most = F.floor(F.col("quota") / F.greatest("source_tokens", F.lit(1)) + F.lit(1e-9)).cast("int")
    plan = quotas.select(
        F.col("source").alias("_source"),
        F.when(F.col("source_tokens") > 0, most).otherwise(1).alias("whole"),
        "source_tokens",
        F.when(F.col("source_tokens") > 0, F.col("quota") - most * F.col("source_tokens")).otherwise(0.0).alias("rest"),
    )
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source")
    last = F.when(F.col("tokens") > 0, F.col("whole")).otherwise(0)
    uses = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    key = F.xxhash64(F.lit(target.seed), F.col("epoch"), F.col("source"), F.col("doc_id"))
    uses = store(uses.withColumn("order_key", key).withColumn("slice", F.shiftrightunsigned(key, 64 - SLICE_BITS).cast("int")))
    # Tokens before each slice of a source's epoch, from sums per slice: bounded rows per source and epoch.
    sums = uses.groupBy("source", "epoch", "slice").agg(F.sum("tokens").alias("in_slice"))
    before = Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
    sums = sums.select(F.col("source").alias("_source"), F.col("epoch").alias("_epoch"), F.col("slice").alias("_slice"), "before")
    same = uses["source"].eqNullSafe(sums["_source"]) & (uses["epoch"] == sums["_epoch"]) & (uses["slice"] == sums["_slice"])
    placed = uses.join(sums, same).drop("_source", "_epoch", "_slice")
    inside = Window.partitionBy("source", "epoch", "slice").orderBy("order_key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    used = placed.where((F.col("epoch") < F.col("whole")) | (F.col("start") < F.col("rest")))
    # Position in the source's whole run of tokens decides the block.
    run = F.col("epoch") * F.col("source_tokens") + F.col("start")
    length = F.col("whole") * F.col("source_tokens") + F.col("rest")
    part = F.floor(run * F.lit(target.blocks) / F.greatest(length, F.lit(1.0))).cast("int")
    block = F.when(F.col("source_tokens") > 0, F.least(part, F.lit(target.blocks - 1)))
    scattered = F.pmod(F.col("order_key"), F.lit(target.blocks)).cast("int")
    return used.select("doc_id", "text_hash", "source", "tokens", "epoch", F.coalesce(block, scattered).alias("block"), "order_key")
