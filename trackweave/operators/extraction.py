"""Measures of new files: an isolated per-file call, or native expressions over samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.functions import signal as S
from trackweave.functions.scalars import KEY_NAMES, as_float, as_int, beat_confidence, key_index, scale_index
from trackweave.operators.chunks import chunk_measures
from trackweave.schema import FEATURES_SCHEMA, INTEGER_MEASURES, MEASURES
from trackweave.sources.m3u import open_filesystem

# What a track gets for a measure that could not be taken.
MEASURE_DEFAULTS = {
    "bpm": 0.0,
    "beat_confidence": 0.0,
    "centroid": 0.0,
    "loudness": 0.0,
    "danceability": 0.0,
    "key": -1,
    "scale": 0,
    "onset_rate": 0.0,
    "zcr": 0.0,
}

# A file takes seconds: a task of some hundred is long enough, and cheap to repeat.
FILES_PER_TASK = 200

# Called with the path and the opened file, which it may read whole or piece by piece.
Extractor = Callable[[str, BinaryIO], dict]


def extract_measures(files: DataFrame, extractor: Extractor, tasks: int | None = None) -> DataFrame:
    """Call ``extractor(path, opened_file)`` for each file; failures become ``error`` text.

    Only file names travel: each task opens its own files, one at a time. No file is lost:
    every input row gives one output row. Without ``tasks`` the files are counted and dealt to at
    least four tasks per core, or as many as get ``FILES_PER_TASK`` each.
    """
    measured = [T.StructField(c, FEATURES_SCHEMA[c].dataType) for c in MEASURES]
    schema = T.StructType([*files.schema.fields, *measured, T.StructField("error", T.StringType())])

    def measure(path: str) -> dict:
        try:
            fs, inner = open_filesystem(path)
            with fs.open_input_file(inner) as source:
                found = extractor(path, source)
            return {**found, "error": None} if found else {"error": "no features"}
        except Exception as failure:  # noqa: BLE001 - one bad file must not fail the task
            return {"error": f"{type(failure).__name__}: {failure}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([measure(p) for p in batch["file_path"]], index=batch.index)
            found = found.reindex(columns=[*MEASURES, "error"])
            for name in MEASURES:
                found[name] = pd.to_numeric(found[name], errors="coerce")
                if name in INTEGER_MEASURES:
                    found[name] = found[name].astype("Int32")
            yield pd.concat([batch, found], axis=1)

    cores = files.sparkSession.sparkContext.defaultParallelism
    # A count of its own: adaptive execution would put this many short names into one task.
    count = tasks or max(4 * cores, -(-files.count() // FILES_PER_TASK))
    return files.repartition(count, "file_path").mapInPandas(run, schema)


def fill_required(measured: DataFrame) -> DataFrame:
    """NULL tempo, centroid or duration becomes 0; danceability is left as it is."""
    return measured.fillna(0.0, ["bpm", "centroid", "duration"])


def _raw_measures(tracks: DataFrame) -> dict[str, Column]:
    """Raw extractor outputs as numbers, by the type they come in.

    Keys and scales may be names, an onset rate may be an array of arrays; the confidence is clamped.
    """
    types = {f.name: f.dataType for f in tracks.schema}
    raw = {c: as_float(F.col(c)) for c in ("bpm", "danceability", "onset_rate") if c in types}
    if "beat_confidence" in types:
        raw["beat_confidence"] = beat_confidence(as_float(F.col("beat_confidence")))
    if isinstance(types.get("onset_rate"), T.ArrayType):
        nested = isinstance(types["onset_rate"].elementType, T.ArrayType)
        raw["onset_rate"] = S.first_number(F.col("onset_rate"), nested)
    for name, named, is_name in (
        ("key", key_index, lambda c: c.isin(KEY_NAMES)),
        ("scale", scale_index, lambda c: c.isin("major", "minor")),
    ):
        if name in types:
            number = F.coalesce(F.col(name).try_cast("int"), F.lit(MEASURE_DEFAULTS[name]))
            text = isinstance(types[name], T.StringType)
            raw[name] = F.when(is_name(F.col(name)), named(F.col(name))).otherwise(number) if text else number
    return raw


def measures_from_samples(
    tracks: DataFrame,
    failed: str = "error",
    min_samples: int = S.MIN_SAMPLES,
    min_key_samples: int = S.MIN_KEY_SAMPLES,
) -> DataFrame:
    """Measures of a table with ``samples`` and the raw extractor outputs it may carry.

    Loudness, zero-crossing rate and spectral centroid come from the samples. Raw outputs
    (bpm, beat_confidence, danceability, key, scale, onset_rate) are taken where present.
    Tracks under ``min_samples`` (a second), or with an error noted in ``failed``, keep all
    defaults; the key needs ``min_key_samples``. The duration is always real. Empty tracks
    get ``error``. Arrow batches are cut by bytes, so a task holds some tracks at a time.
    """
    measured = tracks.withColumn("_m", S.measures(F.col("samples")))
    features = _gated(measured, F.size("samples"), failed, min_samples, min_key_samples)
    return features.drop("_m", "samples")


def measures_from_chunks(
    tracks: DataFrame,
    chunks: DataFrame,
    key: str,
    failed: str = "error",
    min_samples: int = S.MIN_SAMPLES,
    min_key_samples: int = S.MIN_KEY_SAMPLES,
) -> DataFrame:
    """``measures_from_samples`` for samples in ``chunks`` (key, start, samples), of tracks of any length.

    One row for each row of ``tracks``, which carries the raw outputs; a track without chunks, or whose
    chunks have no sample, is empty (duration 0; a null buffer has a null duration). Chunks that
    do not cover their track once from its beginning leave all defaults and the error "missing samples".
    """
    sums = chunk_measures(chunks, key).select(
        F.col(key).alias("_key"), F.struct("n", "rms", "zcr", "slope", "whole").alias("_m")
    )
    met = tracks.join(sums, tracks[key].eqNullSafe(sums["_key"]), "left").drop("_key")
    missing = F.when(~F.col("_m.whole"), F.lit("missing samples"))
    noted = F.col(failed) if failed in tracks.columns else F.lit(None).cast("string")
    met = met.withColumn(failed, F.coalesce(missing, noted))
    return _gated(met, F.coalesce("_m.n", F.lit(0)), failed, min_samples, min_key_samples).drop("_m")


def _gated(measured: DataFrame, length: Column, failed: str, min_samples: int, min_key_samples: int) -> DataFrame:
    """Measures out of ``_m`` (rms, zcr, slope) and the raw outputs, defaults where a track is too short or failed."""
    present = set(measured.columns)
    raw = {
        **_raw_measures(measured),
        "loudness": F.col("_m.rms"),
        "zcr": F.col("_m.zcr"),
        "centroid": S.centroid_hz(F.col("_m.slope")),
    }
    if "key" in present:
        raw["key"] = F.when(length >= min_key_samples, raw["key"]).otherwise(-1)
        raw["scale"] = F.when(length >= min_key_samples, raw.get("scale", F.lit(0))).otherwise(0)
    complete = length >= min_samples
    if failed in present:
        complete = complete & F.col(failed).isNull()
    columns = {"duration": length / F.lit(float(S.SAMPLE_RATE))}
    for name, default in MEASURE_DEFAULTS.items():
        coerce = as_int if name in INTEGER_MEASURES else as_float
        value = coerce(raw[name]) if name in raw else F.lit(default)
        columns[name] = F.when(complete, value).otherwise(F.lit(default)).cast(FEATURES_SCHEMA[name].dataType)
    noted = F.col(failed) if failed in present else F.lit(None).cast("string")
    empty = F.when(F.coalesce(length, F.lit(0)) <= 0, F.lit("empty audio"))
    return measured.withColumns({**columns, failed: F.coalesce(empty, noted)})
