"""Coercions, clamps and key indexes that follow Python's treatment of NULL, NaN and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chromatic scale; the index of a name is its stored key number.
KEY_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def number_or_null(value: Column) -> Column:
    """``value`` as a double, NULL when it is not a number.

    A Java cast also takes ``1d``, ``2f`` and hexadecimal text, which are not numbers here.
    """
    java_only = value.cast("string").rlike(r"(?i)[0-9.][df]\s*$|^\s*[+-]?0x")
    return F.when(~java_only, value.try_cast("double"))


def as_float(value: Column) -> Column:
    return F.coalesce(number_or_null(value), F.lit(0.0))


def as_int(value: Column) -> Column:
    """Whole number; fractions truncate, text holding a fraction and NaN give 0."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def at_least_zero(value: Column) -> Column:
    """Clamp below at 0; NaN gives 0, NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.nanvl(value, F.lit(0.0))))


def unit_interval(value: Column) -> Column:
    """Clamp to [0, 1]; NaN gives 0, NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.lit(1.0), at_least_zero(value)))


def beat_confidence(value: Column) -> Column:
    """Clamp to [0, 1]; NaN gives 1, NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def key_index(name: Column) -> Column:
    """Position of a key name in the chromatic scale, -1 when unknown."""
    names = F.array(*[F.lit(k) for k in KEY_NAMES])
    return F.coalesce((F.array_position(names, name) - 1).cast("int"), F.lit(-1))


def scale_index(name: Column) -> Column:
    return F.coalesce((name == "major").cast("int"), F.lit(0))
