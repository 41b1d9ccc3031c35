import random

import pytest

WORDS = "the of and to in is that for it as was on with be by at this from are or an".split()


def prose(rng: random.Random, n: int) -> str:
    """n invented words, a third of them common."""
    return " ".join(rng.choice(WORDS) if rng.random() < 0.33 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(4, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    long_ = prose(rng, 9000)
    text = prose(rng, 120)
    rows = [
        (1, text, "en"), (2, text, "en"), (2, text, "en"), (3, None, "en"), (4, "", None), (5, " \t\n", "en"), (6, "word", "en"),
        (7, long_, "en"), (8, long_ + " tail", None), (None, text, "en"), (None, None, None), (9, "é世界🙂  x", "en"), (10, "Ab ab AB aB", "de"), (11, "ab\tAB\nab ab", "de"),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "n", 0.5, "z") for r in rows], "doc_id long, text string, lang string, row long, node long, slot long, part long, x string, score double, kept_text string")
    return df


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
