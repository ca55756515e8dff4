"""Category labels and composed names as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.scalars import KEY_NAMES, number_or_null

# Fixed values. A ladder lists (upper bound, label) from low to high: a value takes the
# first label whose bound lies above it, and the last label when none does.
RULE_TEMPO = [(70.0, "Slow"), (100.0, "Medium"), (130.0, "Upbeat"), (160.0, "Fast"), (None, "VeryFast")]
RULE_ENERGY = [(0.3, "Chill"), (0.5, "Mellow"), (0.7, "Groovy"), (0.85, "Energetic"), (None, "Intense")]
RULE_MOOD = [(500.0, "Warm"), (1500.0, "Mellow"), (3000.0, "Balanced"), (6000.0, "Bright"), (None, "Crisp")]

CLUSTER_TEMPO = [(70.0, "Slow"), (100.0, "Medium"), (130.0, "Upbeat"), (None, "Fast")]
CLUSTER_DANCE = [(0.3, "Chill"), (0.5, "Easy"), (0.7, "Groovy"), (0.85, "Dance"), (None, "Energetic")]
CLUSTER_TIMBRE = [(300.0, "Relaxing"), (1000.0, "Mellow"), (2000.0, "Balanced"), (4000.0, "Bright"), (None, "Intense")]

DOCUMENTED_TEMPO = [
    (55.0, "VerySlow"),
    (70.0, "Slow"),
    (85.0, "Chill"),
    (100.0, "Medium"),
    (115.0, "Upbeat"),
    (135.0, "Energetic"),
    (155.0, "Fast"),
    (None, "VeryFast"),
]
DOCUMENTED_TIMBRE = [
    (800.0, "Dark"),
    (1500.0, "Warm"),
    (2200.0, "Mellow"),
    (3000.0, "Bright"),
    (4000.0, "Sharp"),
    (None, "VerySharp"),
]
DOCUMENTED_DURATION = [(60.0, "Brief"), (120.0, "Short"), (180.0, "Medium"), (240.0, "Long"), (None, "VeryLong")]

Ladder = list[tuple[float | None, str]]


def known_step(value: Column, ladder: Ladder) -> Column:
    """Index of the ladder step holding a ``value`` known not to be NULL; last step for NaN.

    Never NULL, so joins on the index add no filter that would evaluate it twice.
    """
    index = F.when(value < F.lit(ladder[0][0]), F.lit(0))
    for i, (bound, _) in enumerate(ladder[1:-1], start=1):
        index = index.when(value < F.lit(bound), F.lit(i))
    return index.otherwise(F.lit(len(ladder) - 1))


def step_index(value: Column, ladder: Ladder) -> Column:
    """Index of the ladder step holding ``value``; NULL for NULL, last step for NaN."""
    return F.when(value.isNotNull(), known_step(value, ladder))


def step_label(value: Column, ladder: Ladder) -> Column:
    """Label of the ladder step holding ``value``."""
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in ladder[:-1]:
        label = label.when(value < F.lit(bound), F.lit(name))
    return label.otherwise(F.lit(ladder[-1][1]))


def ladder_name(index: Column, ladder: Ladder) -> Column:
    """Label of a step index."""
    return F.get(F.array(*[F.lit(name) for _, name in ladder]), index)


def split_from(playlist: Column) -> Column:
    """Name of the group that a split playlist was cut from by its own mood; other names stay.

    A group's suffix follows from its mood, so its own mood's name can only stand behind that suffix.
    """
    return F.regexp_replace(playlist, "(?:_Balanced|(?<=_Warm)_(?:Warm|Mellow)|(?<=_Bright)_(?:Bright|Crisp))$", "")


def bpm_group(bpm: Column) -> Column:
    return step_label(bpm, RULE_TEMPO)


def energy_group(danceability: Column) -> Column:
    return step_label(danceability, RULE_ENERGY)


def mood_group(centroid: Column) -> Column:
    return step_label(centroid, RULE_MOOD)


def mood_rank(centroid: Column) -> Column:
    """0 (Warm) to 4 (Crisp)."""
    return step_index(centroid, RULE_MOOD)


def valid_key(key: Column) -> Column:
    return F.coalesce(key.between(0, 11), F.lit(False))


def key_group(key: Column, scale: Column) -> Column:
    """``C#_Minor`` and the like for a valid key, an empty string otherwise."""
    tonic = F.get(F.array(*[F.lit(k) for k in KEY_NAMES]), key.cast("int"))
    mode = F.when(scale == 1, F.lit("Major")).otherwise(F.lit("Minor"))
    return F.when(valid_key(key), F.concat_ws("_", tonic, mode)).otherwise(F.lit(""))


def mood_suffix(mood: Column) -> Column:
    """Bright for the two high moods, Warm for the two low ones, NULL for Balanced."""
    return F.when(mood.isin("Bright", "Crisp"), F.lit("Bright")).when(mood.isin("Warm", "Mellow"), F.lit("Warm"))


def rule_name(bpm: Column, energy: Column, key: Column, mood: Column) -> Column:
    """Composed playlist name out of the four group labels."""
    return F.concat_ws("_", bpm, energy, F.nullif(key, F.lit("")), mood_suffix(mood))


def cluster_name(bpm: Column, centroid: Column, danceability: Column) -> Column:
    """Three descriptive words; when any input is not a number all three count as 0."""
    numbers = [number_or_null(c) for c in (bpm, centroid, danceability)]
    usable = numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    tempo, timbre, dance = (F.when(usable, n).otherwise(F.lit(0.0)) for n in numbers)
    return F.concat_ws(
        " ",
        step_label(tempo, CLUSTER_TEMPO),
        step_label(dance, CLUSTER_DANCE),
        step_label(timbre, CLUSTER_TIMBRE),
    )


def underscored(name: Column) -> Column:
    return F.translate(name, " ", "_")


def documented_tempo(bpm: Column) -> Column:
    return step_label(bpm, DOCUMENTED_TEMPO)


def documented_timbre(centroid: Column) -> Column:
    return step_label(centroid, DOCUMENTED_TIMBRE)


def documented_duration(duration: Column) -> Column:
    return step_label(duration, DOCUMENTED_DURATION)


def energy_number(beat_confidence: Column) -> Column:
    """0 to 10, the floor of ten times the clamped confidence."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), beat_confidence))
    return F.when(beat_confidence.isNotNull(), F.floor(clamped * 10).cast("int"))


def energy_level(beat_confidence: Column) -> Column:
    return F.concat(F.lit("E"), energy_number(beat_confidence).cast("string"))


def documented_mood(tempo: Column, timbre: Column, energy: Column) -> Column:
    """Mood from documented tempo and timbre labels and the 0..10 energy number."""
    return (
        F.when((tempo == "VerySlow") & (timbre == "Dark"), F.lit("Ambient"))
        .when(tempo.isin("VerySlow", "Slow", "Chill") & (energy <= 3), F.lit("Downtempo"))
        .when(tempo.isin("Energetic", "Fast", "VeryFast") & (energy >= 7), F.lit("Dance"))
        .when(timbre.isin("Bright", "Sharp", "VerySharp") & (energy >= 7), F.lit("Dynamic"))
        .otherwise(F.lit("Balanced"))
    )


def documented_name(bpm: Column, centroid: Column, duration: Column, beat_confidence: Column) -> Column:
    """All five parts; NULL if any measure is, so that parts never shift."""
    tempo, timbre = documented_tempo(bpm), documented_timbre(centroid)
    known = bpm.isNotNull() & centroid.isNotNull() & duration.isNotNull() & beat_confidence.isNotNull()
    name = F.concat_ws(
        "_",
        tempo,
        timbre,
        documented_duration(duration),
        energy_level(beat_confidence),
        documented_mood(tempo, timbre, energy_number(beat_confidence)),
    )
    return F.when(known, name)
