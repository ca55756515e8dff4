"""Mini-batch k-means: centers move by small keyed samples, not by passes over all tracks.

A round takes ``batch`` rows. Each goes to its nearest center; per center a Spark aggregate gives their number and sum,
and the center moves towards their mean at a rate of its own, the batch's share of all rows it has ever
received. So centers are means merged by counts, whatever the split of the rows into tasks.

All rounds' samples are drawn in one scan: rows are ordered by a hash of an epoch and their number, and
consecutive stretches of that order are the rounds; a table too small for all rounds is gone through in
several epochs. What is kept of the tracks is rounds times batch rows, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.clustering import NUM_PLAYLISTS, SEED, WEIGHTS, Clustered, nearest_center
from trackweave.session import store

# Range of the keys that order an epoch.
KEYS = 1 << 31


def hashed_key(order: str, seed: int) -> Callable[[int], Column]:
    """For each epoch, an even key below KEYS from the row's number."""
    return lambda epoch: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(order)), 33)


@dataclass(frozen=True)
class MiniBatch:
    """``rounds`` at most, of ``batch`` rows; ends earlier once the smoothed inertia has not fallen for ``patience`` rounds
    (0: never). Start centers are chosen among ``init`` batches of rows."""

    rounds: int = 100
    batch: int = 500
    patience: int = 10
    init: int = 3


def first_by_key(rows: DataFrame, key: Column, order: str, wanted: int, total: int) -> DataFrame:
    """The ``wanted`` rows with the least keys, with their place ``nth`` from 0.

    Only rows below a threshold are ordered, about a fifth more than wanted; it rises until enough have come.
    """
    keyed = rows.withColumn("_key", key)
    share = 1.2 * wanted / max(total, 1) + 50 / max(total, 1)
    while True:
        some = keyed if share >= 1 else keyed.where(F.col("_key") < F.lit(int(share * KEYS)))
        some = store(some)
        if share >= 1 or some.count() >= wanted:
            break
        share *= 2
    place = F.row_number().over(Window.orderBy("_key", order)) - 1
    return some.withColumn("nth", place).where(F.col("nth") < wanted).drop("_key")


def draw(rows: DataFrame, order: str, how: MiniBatch, key: Callable[[int], Column], total: int) -> DataFrame:
    """All rounds' samples with their ``round``: disjoint within an epoch, which has as many as the rows give."""
    batch = min(how.batch, total)
    each = max(1, total // batch)
    out, first, epoch = None, 0, 0
    while first < how.rounds:
        rounds = min(each, how.rounds - first)
        part = first_by_key(rows, key(epoch), order, rounds * batch, total)
        part = part.withColumn("round", (F.floor(F.col("nth") / batch) + first).cast("int")).drop("nth")
        out = part if out is None else out.unionByName(part)
        first, epoch = first + rounds, epoch + 1
    return store(out.repartition(1, "round").sortWithinPartitions("round"))


def plus_plus(points: np.ndarray, k: int, seed: int, tries: int = 3) -> list[tuple[float, ...]]:
    """Start centers out of a bounded sample: each next one by its squared distance from those chosen.

    Of some candidates for each center, and of some whole choices, the one that leaves the least distance is taken.
    """
    rng = np.random.default_rng(seed)
    best, least = None, np.inf
    for _ in range(tries):
        chosen = [points[rng.integers(len(points))]]
        far = ((points - chosen[0]) ** 2).sum(axis=1)
        while len(chosen) < k:
            chance = far / far.sum() if far.sum() > 0 else None
            candidates = rng.choice(len(points), size=2 + int(np.log(k)), p=chance)
            left = [np.minimum(far, ((points - points[c]) ** 2).sum(axis=1)) for c in candidates]
            pick = int(np.argmin([x.sum() for x in left]))
            chosen.append(points[candidates[pick]])
            far = left[pick]
        if far.sum() < least:
            best, least = chosen, far.sum()
    return [tuple(float(x) for x in c) for c in best]


def move(centers: list[tuple[float, ...]], seen: list[int], sums: list) -> tuple[list[tuple[float, ...]], list[int]]:
    """Centers after a batch: ``sums`` are (center, rows, sum per column) of those that got rows."""
    centers, seen = list(centers), list(seen)
    for at, rows, *totals in sums:
        seen[at] += rows
        centers[at] = tuple(c + (t - rows * c) / seen[at] for c, t in zip(centers[at], totals))
    return centers, seen


def minibatch_clusters(
    scaled: DataFrame,
    k: int = NUM_PLAYLISTS,
    seed: int = SEED,
    weights: dict[str, float] = WEIGHTS,
    how: MiniBatch = MiniBatch(),
    order: str = "ingest_seq",
    start: list[tuple[float, ...]] | None = None,
    key: Callable[[int], Column] | None = None,
) -> Clustered:
    """K-means over the weighted measures by mini-batches; at most one cluster per row.

    ``order`` is a unique bigint; ``start`` gives the first centers and ``key`` the keys of an epoch, else both follow
    ``seed``. ``converged`` tells whether the rounds ended before their number was used up.
    """
    if k <= 0:
        raise ValueError(f"number of playlists must be positive, not {k}")
    total = scaled.count()
    if total <= 1 or (k == 1 and start is None):
        return Clustered(scaled.withColumn("cluster", F.lit(0)), [], True)
    key = key or hashed_key(order, seed)
    columns = [f"{c}_w" for c in weights]
    points = scaled.select(order, *columns)
    if start is None:
        some = first_by_key(points, key(-1), order, min(how.init * how.batch, total), total)
        start = plus_plus(np.array([list(r) for r in some.orderBy("nth").select(*columns).collect()]), min(k, total), seed)
    samples = draw(points, order, how, key, total)
    centers, seen = list(start), [0] * len(start)
    smooth = best = None
    idle, ended = 0, False
    alpha = min(1.0, 2.0 * min(how.batch, total) / (total + 1))
    for number in range(how.rounds):
        found = samples.where(F.col("round") == number).withColumn("near", nearest_center(centers, columns))
        sums = found.groupBy("near.id").agg(F.count("*"), *[F.sum(c) for c in columns], F.sum("near.distance")).collect()
        centers, seen = move(centers, seen, [tuple(r)[:-1] for r in sums])
        inertia = sum(r[-1] for r in sums) / sum(r[1] for r in sums)
        smooth = inertia if smooth is None else smooth * (1 - alpha) + inertia * alpha
        idle = 0 if best is None or smooth < best else idle + 1
        best = smooth if best is None else min(best, smooth)
        if how.patience and idle >= how.patience:
            ended = True
            break
    placed = scaled.withColumn("cluster", nearest_center(centers, columns)["id"])
    return Clustered(placed, centers, ended)
