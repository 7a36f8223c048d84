import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ra", "ne", "vo") for c in ("", "n", "st", "ble", "ing", "é")]


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words in sentences."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + ("." if i % 12 == 11 else "") for i in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Documents with nulls, empty and very long texts, repeated rows and columns of clashing names."""
    rows = [(1, prose(80, 1), "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "en"), (5, "one", "en"), (None, prose(80, 2), "en"), (6, prose(40000, 3), "en"), (1, prose(80, 1), "en"), (7, prose(80, 1), None), (8, "éß 日本 🙂", "en"), (9, "123 !!", "en")]
    df = spark.createDataFrame([(*r, i, "x", 0.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, n_words long, media string, score double")
    return df, rows


@pytest.fixture(scope="session")
def docs001(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
