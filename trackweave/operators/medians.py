"""Exact medians of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.session import settle

# Up to this many rows per group the built-in median may hold one group's values in a task.
DIRECT_ROWS = 500_000
GRID = 1000
ACCURACY = 10_000


def exact_medians(rows: DataFrame, key: str, columns: list[str], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """One row per ``key``: ``size`` and the interpolated median of each column.

    The built-in ``median`` keeps every distinct value of a group in one task. Groups are
    therefore counted first; when one is larger than ``direct_rows`` the medians come from
    :func:`narrowed_medians`, which is exact too.
    """
    sizes = settle(rows.groupBy(key).agg(F.count("*").alias("size")))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    if largest <= direct_rows:
        return rows.groupBy(key).agg(F.count("*").alias("size"), *[F.median(c).alias(c) for c in columns])
    medians = narrowed_medians(rows, key, columns, direct_rows)
    wide = medians.groupBy(key).agg(
        *[F.max(F.when(F.col("measure") == c, F.col("median"))).alias(c) for c in columns]
    )
    return sizes.join(wide, key).select(key, "size", *columns)


def narrowed_medians(rows: DataFrame, key: str, columns: list[str], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """(key, measure, median) for groups too large for one task.

    Each round brackets the middle rows between grid points of an approximate quantile
    sketch and counts the rows below the bracket. A bracket that misses the middle
    (sketch error) is dropped in favour of the former one, so the result never depends on
    the sketch; where a round has not narrowed anything the next one halves the range of values.
    Rounds go on until every bracket holds few rows or two values at most; then the distinct values
    inside are counted and walked. All columns share the passes, two a round; the first sketch is
    taken with the range of values. Every table but ``rows`` holds one line per key.
    """
    each = range(len(columns))
    values = rows.select(key, *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    kept = [f"{name}{i}" for i in each for name in ("total", "lo", "hi", "below", "held", "between")]
    points = [p / GRID for p in range(GRID + 1)]

    def of(i: int, *names: str) -> list[Column]:
        return [F.col(f"{name}{i}") for name in names]

    def middle(i: int) -> list[Column]:
        """Ranks of the middle rows, from 0."""
        return [F.floor((F.col(f"total{i}") - 1) / 2), F.floor(F.col(f"total{i}") / 2)]

    def per_key(bounds: DataFrame, *parts: Column) -> DataFrame:
        """``bounds`` with aggregates over the rows of each key, which see the bounds."""
        found = values.join(F.broadcast(bounds), key).groupBy(key).agg(*parts)
        return settle(bounds.join(found, key))

    def by_sketch(i: int) -> list[Column]:
        total, below, held, grid = of(i, "total", "below", "held", "grid")
        step = F.floor((total / 2 - below) / F.greatest(held, F.lit(1)) * GRID).cast("int")
        new_lo, new_hi = F.get(grid, F.greatest(step - 1, F.lit(0))), F.get(grid, F.least(step + 2, F.lit(GRID)))
        return [new_lo.alias(f"new_lo{i}"), new_hi.alias(f"new_hi{i}")]

    def halved(bounds: DataFrame) -> DataFrame:
        """Bounds cut at the middle of their values: the half with both middle rows, or the two values around."""
        parts, cuts = [], []
        for i in each:
            v, lo, hi, below, left, last, after = of(i, "v", "lo", "hi", "below", "left", "last", "after")
            inside, cut = v.between(lo, hi), lo / 2 + hi / 2
            parts += [
                F.count_if(inside & (v <= cut)).alias(f"left{i}"),
                F.max(F.when(inside & (v <= cut), v)).alias(f"last{i}"),
                F.min(F.when(inside & (v > cut), v)).alias(f"after{i}"),
            ]
            first_half, second_half = middle(i)[1] < below + left, middle(i)[0] >= below + left
            cuts += [
                F.when(second_half, F.coalesce(after, lo)).when(first_half, lo).otherwise(last).alias(f"new_lo{i}"),
                F.when(first_half, last).when(second_half, hi).otherwise(after).alias(f"new_hi{i}"),
            ]
        return per_key(bounds, *parts).select(key, *kept, *cuts)

    def narrowed(tried: DataFrame) -> DataFrame:
        """The bounds tried where they hold the middle rows, else the former ones, with the rows in and between them."""
        parts, picked = [], []
        for i in each:
            v, lo, hi, new_lo, new_hi = of(i, "v", "lo", "hi", "new_lo", "new_hi")
            below, held, under, within = of(i, "below", "held", "under", "within")
            parts += [
                F.count_if(v.between(lo, hi) & (v < new_lo)).alias(f"under{i}"),
                F.count_if(v.between(lo, hi) & v.between(new_lo, new_hi)).alias(f"within{i}"),
                F.count_if((v > lo) & (v < hi)).alias(f"former{i}"),
                F.count_if((v > new_lo) & (v < new_hi)).alias(f"inner{i}"),
            ]
            holds = (below + under <= middle(i)[0]) & (middle(i)[1] < below + under + within)
            picked += [F.col(f"total{i}")] + [
                F.when(holds, new).otherwise(old).alias(f"{name}{i}")
                for name, new, old in (
                    ("lo", new_lo, lo),
                    ("hi", new_hi, hi),
                    ("below", below + under, below),
                    ("held", within, held),
                    ("between", F.col(f"inner{i}"), F.col(f"former{i}")),
                )
            ]
        return per_key(tried, *parts).select(key, *picked)

    def sketched(i: int, value: Column) -> Column:
        return F.percentile_approx(value, points, ACCURACY).alias(f"grid{i}")

    start, begin = [], []
    for i in each:
        v, total = of(i, "v", "total")
        start += [F.count(v).alias(f"total{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), sketched(i, v)]
        begin += [F.lit(0).cast("long").alias(f"below{i}"), total.alias(f"held{i}"), total.alias(f"between{i}")]
    tried = settle(values.groupBy(key).agg(*start).select("*", *begin))
    tried = tried.select(key, *kept, *[c for i in each for c in by_sketch(i)])
    left = None
    while True:
        bounds = narrowed(tried)
        open_rows = F.lit(0).cast("long")
        for i in each:
            lo, hi, held, between = of(i, "lo", "hi", "held", "between")
            # Two values are few, however many rows have them.
            open_rows += F.when((held > direct_rows) & (lo < hi), between).otherwise(0)
        rest = bounds.agg(F.coalesce(F.sum(open_rows), F.lit(0))).first()[0]
        if not rest:
            break
        stalled, left = rest == left, rest
        if stalled:
            tried = halved(bounds)
        else:
            inside = [(i, *of(i, "v", "lo", "hi")) for i in each]
            found = per_key(bounds, *[sketched(i, F.when(v.between(lo, hi), v)) for i, v, lo, hi in inside])
            tried = found.select(key, *kept, *[c for i in each for c in by_sketch(i)])

    met = values.join(F.broadcast(bounds), key)
    in_bounds = [v.between(lo, hi) for v, lo, hi in (of(i, "v", "lo", "hi") for i in each)]
    entries = [
        F.struct(
            F.lit(c).alias("measure"),
            F.when(in_bounds[i], F.col(f"v{i}")).alias("v"),
            *[F.col(f"{name}{i}").alias(name) for name in ("total", "below")],
        )
        for i, c in enumerate(columns)
    ]
    on = [key, "measure"]
    running = Window.partitionBy(*on).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    walked = (
        met.where(reduce(Column.__or__, in_bounds))
        .select(key, F.inline(F.array(*entries)))
        .where(F.col("v").isNotNull())
        .groupBy(*on, "v", "total", "below")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.col("below") + F.sum("n").over(running))
    )
    ranked = [F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)]
    covers = [(F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")) for rank in ranked]
    return (
        walked.where(covers[0] | covers[1])
        .groupBy(on)
        .agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    )
