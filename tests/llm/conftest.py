import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, _id string, spans string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Odd rows: nulls, empty and blank texts, ties, repeated rows, a very long text, near copies; columns with clashing names."""
    base = words(120, 1)
    out = [
        (1, "Alpha beta  gamma", "en", "a", 1),
        (2, "Alpha beta\tgamma", "en", "a", 1),
        (3, None, "en", None, None),
        (4, "", None, "b", 0),
        (5, " \t\n", "en", "b", 3),
        (6, "12345 !!! 678", "de", "b", 3),
        (None, "no id here", "en", "a", 1),
        (None, None, None, None, None),
        (7, " ".join(words(21_000, 2, 50_000)), "en", "c", 9),
        (8, "same row", "fr", "c", 1),
        (8, "same row", "fr", "c", 1),
        (8, "same id, another text", "fr", "c", 1),
        (9, "é ü ß Ünïcode wörds", "de", "é", 1),
    ]
    for k in range(60):
        w = list(base)
        if k:
            w[k] = f"new{k}"
        out.append((100 + k, " ".join(w), "en", "a", 1))
    for k in range(40):
        out.append((300 + k, " ".join(words(60, 1000 + k, 5000)), "es" if k % 2 else "en", f"s{k % 5}", 1))
    return [(*r, 1, "x", "y") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
