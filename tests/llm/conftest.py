from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choices("abcdeghilmnoprstu", k=rng.randint(2, 8))) for _ in range(words)]
    for i in range(9, words, 10):
        made[i] += ".\n" if i % 40 == 39 else "."
    return " ".join(made)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a long one, ties and repeated rows."""
    same = prose(1, 120)
    return [
        (1, same, "en", "a", 5),
        (2, same, "en", "a", 5),
        (2, same, "en", "a", 5),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \t\n\r ", "en", None, 5),
        (None, prose(2, 80), "en", "b", 5),
        (None, None, None, None, None),
        (6, prose(3, 30_000), "en", "c", 5),
        (7, "é 日本 😀 one", "fr", "c", 5),
        (8, "one one one one one one one one", "en", "é", 5),
        (9, prose(4, 60), "en", None, 5),
        (9, prose(5, 70), "en", "b", 5),
    ]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
