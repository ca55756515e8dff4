import random

import pytest
from corpus import words

COLUMNS = "doc_id bigint, text string, source string, n_chars bigint, n_words string, component_id string, _hash string, text_hash string, score string, host string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and extra columns named like the operators' own."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    plain = words(rng, 120)
    rows = [
        (1, plain, "a"),
        (1, plain, "a"),
        (2, None, "a"),
        (3, "", None),
        (None, plain, "b"),
        (None, None, None),
        (4, long, "b"),
        (5, " \n\t ", "a"),
        (6, words(rng, 90), None),
        (6, words(rng, 90), "b"),
    ]
    extra = ("x", "x", "x", "x", "x", "x")
    return spark.createDataFrame([(i, t, s, len(t or ""), *extra) for i, t, s in rows], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
