"""Table schemas, additive evolution and create-if-absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES_SCHEMA = T.StructType(
    [
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("duration", T.DoubleType()),
        T.StructField("bpm", T.DoubleType()),
        T.StructField("beat_confidence", T.DoubleType()),
        T.StructField("centroid", T.DoubleType()),
        T.StructField("loudness", T.DoubleType()),
        T.StructField("danceability", T.DoubleType()),
        T.StructField("key", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
        T.StructField("onset_rate", T.DoubleType()),
        T.StructField("zcr", T.DoubleType()),
        T.StructField("last_modified", T.DoubleType()),
        T.StructField("last_analyzed", T.TimestampNTZType()),
        T.StructField("ingest_seq", T.LongType(), False),
    ]
)

PLAYLISTS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("last_updated", T.TimestampNTZType()),
    ]
)

PLAYLIST_TRACKS_SCHEMA = T.StructType(
    [
        T.StructField("playlist_id", T.LongType(), False),
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("added", T.TimestampNTZType()),
    ]
)

# The ten measured attributes of a track, in table order.
MEASURES = [
    "duration",
    "bpm",
    "beat_confidence",
    "centroid",
    "loudness",
    "danceability",
    "key",
    "scale",
    "onset_rate",
    "zcr",
]
INTEGER_MEASURES = {"key", "scale"}

# Columns that older tables may lack, with the value their rows get.
ADDED_COLUMN_DEFAULTS = {
    "loudness": 0.0,
    "danceability": 0.0,
    "key": -1,
    "scale": 0,
    "onset_rate": 0.0,
    "zcr": 0.0,
}


def evolve_features(df: DataFrame) -> DataFrame:
    """Add the columns an older table lacks; NULLs already stored stay NULL."""
    return df.withColumns(
        {
            name: F.lit(default).cast(FEATURES_SCHEMA[name].dataType)
            for name, default in ADDED_COLUMN_DEFAULTS.items()
            if name not in df.columns
        }
    )


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table that does not exist yet reads as an empty one with its schema."""
    return spark.createDataFrame([], schema)
