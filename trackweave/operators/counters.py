"""Counters taken while a table is written, so that a report needs no further scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trackweave.session import store


def store_counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``store(df)`` and the aggregates ``metrics`` over the rows that were written.

    They are observed at the last stage, the writing one: what a repeated task counts replaces the lost
    one's. Where the plan folds to nothing before any row is seen, they are taken from the stored table.
    """
    seen = Observation()
    columns = [metric.alias(name) for name, metric in metrics.items()]
    kept = store(df.observe(seen, *columns))
    found = seen.get
    return kept, found if found.keys() == metrics.keys() else kept.agg(*columns).first().asDict()


def store_playlists(tracks: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored playlist tracks, and one row (saved_playlists, saved_tracks, unnamed, balanced).

    ``balanced`` tells whether as many tracks were written as the playlists' sizes add up to; ``unnamed`` counts
    those without a path. The sizes are one row a playlist.
    """
    kept, found = store_counted(
        tracks,
        saved_playlists=F.count_if(F.col("pos") == 1),
        saved_tracks=F.count("*"),
        unnamed=F.count_if(F.col("file_path").isNull()),
    )
    sizes = F.coalesce(F.sum("size"), F.lit(0)).cast("long")
    counted = summary.agg(sizes.alias("_sizes")).select(
        *[F.lit(found[c]).cast("long").alias(c) for c in ("saved_playlists", "saved_tracks", "unnamed")],
        (F.col("_sizes") == found["saved_tracks"]).alias("balanced"),
    )
    return kept, counted
