"""Measures of tracks whose samples lie in chunks, so that a track of hours is no single row.

A chunk is a row (key, start, samples): ``start`` is the place of its first sample in the track. Each chunk gives
partial sums by native expressions; what lies between two chunks follows from the last sample of one and the first
of the next, which meet on (key, place). Rows that travel are a few numbers, whatever the chunks hold, and a track
with very many chunks is summed in parts before its key is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("n", "energy", "change", "flips")


def split_samples(tracks: DataFrame, key: str, size: int, samples: str = "samples") -> DataFrame:
    """(key, start, samples) with at most ``size`` samples a row; a null or empty track is one empty chunk."""
    values = F.coalesce(F.col(samples), F.array().cast("array<float>"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(size))
    rows = tracks.select(F.col(key), values.alias("_all"), F.explode(starts).alias("start"))
    return rows.select(key, F.col("start").cast("long").alias("start"), F.slice("_all", F.col("start") + 1, size).alias("samples"))


def _positive(x: Column) -> Column:
    return (x > 0) & ~F.isnan(x)


def _sums(samples: Column) -> Column:
    """Struct (last, energy, change, flips) of an array in one pass; a null sample counts as NaN."""

    def step(so_far: Column, value: Column) -> Column:
        x = F.coalesce(value.cast("double"), F.lit(math.nan))
        last = so_far["last"]
        moved = F.when(last.isNull(), 0.0).otherwise((x - last) * (x - last))
        flipped = F.when(last.isNotNull() & (_positive(x) != _positive(last)), 1).otherwise(0)
        return F.struct(
            x.alias("last"),
            (so_far["energy"] + x * x).alias("energy"),
            (so_far["change"] + moved).alias("change"),
            (so_far["flips"] + flipped).cast("long").alias("flips"),
        )

    none = F.struct(
        F.lit(None).cast("double").alias("last"),
        F.lit(0.0).alias("energy"),
        F.lit(0.0).alias("change"),
        F.lit(0).cast("long").alias("flips"),
    )
    return F.aggregate(samples, none, step)


def chunk_measures(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n, rms, zcr, slope, whole) per track: what ``functions.signal.measures`` gives for its joined samples.

    ``whole`` tells whether the chunks cover the track from 0 to its end once each; a missing, repeated or overlapping
    chunk makes it false. Empty and null chunks count for nothing; a track without any sample has zeros and is
    whole. Tracks with a null key are one track. Extra columns are ignored.
    """
    samples = F.coalesce(F.col("samples"), F.array().cast("array<float>"))
    summed = chunks.select(
        F.col(key),
        F.col("start").cast("long").alias("start"),
        F.size(samples).cast("long").alias("n"),
        F.coalesce(F.get(samples, F.lit(0)).cast("double"), F.lit(math.nan)).alias("first"),
        _sums(samples).alias("_s"),
    )
    number, whole_number = F.lit(None).cast("double"), F.lit(0).cast("long")

    def row(at: Column, first: Column, last: Column, *parts: Column) -> Column:
        return F.struct(at.alias("at"), first.alias("first"), last.alias("last"), *[p.alias(c) for p, c in zip(parts, PARTS)])

    nothing = (whole_number, F.lit(0.0), F.lit(0.0), whole_number)
    own = (F.col("n"), F.col("_s.energy"), F.col("_s.change"), F.col("_s.flips"))
    begin = row(F.col("start"), F.col("first"), number, *own)
    end = row(F.col("start") + F.col("n"), number, F.col("_s.last"), *nothing)
    empty = row(F.lit(None).cast("long"), number, number, *nothing)
    places = summed.select(key, F.inline(F.when(F.col("n") > 0, F.array(begin, end)).otherwise(F.array(empty))))
    met = places.groupBy(key, "at").agg(
        F.max("first").alias("first"),
        F.max("last").alias("last"),
        F.count("first").alias("begun"),
        F.count("last").alias("ended"),
        *[F.sum(c).alias(c) for c in PARTS],
    )
    border = F.col("first").isNotNull() & F.col("last").isNotNull()
    step = F.col("first") - F.col("last")
    met = met.withColumns(
        {
            "change": F.col("change") + F.when(border, step * step).otherwise(0.0),
            "flips": F.col("flips") + F.when(border & (_positive(F.col("first")) != _positive(F.col("last"))), 1).otherwise(0),
        }
    )
    # Chunks tile a track if each place but 0 ends one, each but the last begins one, and none does so twice.
    somewhere = F.col("at").isNotNull()
    odd = somewhere & ((F.col("begun") > 1) | (F.col("ended") > 1) | ((F.col("ended") == 0) & (F.col("at") != 0)))
    open_ends = F.sum((somewhere & (F.col("begun") == 0)).cast("long"))
    totals = met.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in PARTS],
        (~F.bool_or(odd) & (open_ends <= 1) & (F.coalesce(F.min("at"), whole_number) == 0)).alias("whole"),
    )
    n, energy = F.col("n"), F.col("energy")
    return totals.select(
        key,
        "n",
        F.when(n > 0, F.sqrt(F.try_divide(energy, n))).otherwise(0.0).alias("rms"),
        F.when(n > 0, F.try_divide(F.col("flips"), n)).otherwise(0.0).alias("zcr"),
        F.when(energy != 0, F.sqrt(F.try_divide(F.col("change"), energy))).otherwise(0.0).alias("slope"),
        "whole",
    )
