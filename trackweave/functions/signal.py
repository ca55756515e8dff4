"""Measures of sample arrays.

A track is one long array (minutes of audio are millions of floats), so the array
measures run as one Arrow UDF over the flat value buffer: a single pass per batch,
several times faster than the interpreted higher-order functions. Spark cuts the batches
by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sample rate tracks are decoded at, and the shortest lengths (in
# samples) for measuring anything and for estimating a key.
SAMPLE_RATE = 44100
MIN_SAMPLES = SAMPLE_RATE
MIN_KEY_SAMPLES = 3 * SAMPLE_RATE


MEASURED = T.StructType([T.StructField(c, T.DoubleType()) for c in ("rms", "zcr", "slope")])


@F.arrow_udf(MEASURED)
def _measure(samples: pa.Array) -> pa.Array:
    """Per array: root mean square, sign changes per sample, norm(difference)/norm(signal)."""
    rows = len(samples)
    valid = np.asarray(samples.is_valid())
    offsets = samples.offsets.to_numpy()
    sizes = np.where(valid, np.diff(offsets), 0)
    rms, zcr, slope = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    # One row at a time: the scratch memory is that of one track, and a row's bits never
    # depend on its neighbours.
    for row in np.flatnonzero(sizes):
        x = samples.values[offsets[row] : offsets[row + 1]].to_numpy(zero_copy_only=False).astype("f8")
        energy = np.dot(x, x)
        change = np.diff(x)
        rms[row] = math.sqrt(energy / len(x))
        zcr[row] = np.count_nonzero((x[1:] > 0) != (x[:-1] > 0)) / len(x)
        slope[row] = math.sqrt(np.dot(change, change) / energy) if energy else 0.0
    return pa.StructArray.from_arrays(
        [pa.array(v, mask=~valid) for v in (rms, zcr, slope)],
        ["rms", "zcr", "slope"],
        mask=pa.array(~valid),
    )


def measures(samples: Column) -> Column:
    """Struct (rms, zcr, slope) of an ``array<float>``; NULL for NULL, zeros for empty."""
    return _measure(samples)


def centroid_hz(slope: Column, sample_rate: Column | int = SAMPLE_RATE) -> Column:
    """Time-domain spectral centroid out of norm(difference)/norm(signal)."""
    rate = F.lit(sample_rate) if isinstance(sample_rate, int) else sample_rate
    return rate / F.lit(2 * math.pi) * slope


def nan_mean(values: Column) -> Column:
    """Mean without NaN entries; NaN when nothing is left."""
    kept = F.filter(values, lambda x: ~F.isnan(x))
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(values.isNotNull(), F.coalesce(F.try_divide(total, F.size(kept)), F.lit(float("nan"))))


def plain_mean(values: Column) -> Column:
    """Mean in which one NaN makes the result NaN; NaN when empty."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(values.isNotNull(), F.coalesce(F.try_divide(total, F.size(values)), F.lit(float("nan"))))


def first_number(values: Column, nested: bool = False) -> Column:
    """First element of an array, or of its first array; 0.0 when there is none."""
    head = F.get(values, F.lit(0))
    return F.coalesce((F.get(head, F.lit(0)) if nested else head).cast("double"), F.lit(0.0))


def duration_seconds(samples: Column) -> Column:
    return F.size(samples) / F.lit(float(SAMPLE_RATE))
