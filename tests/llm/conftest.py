import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " id long, row string, k1 long, start long, fp long, score double, label int, word string, item string"
)


def row(doc_id, text):
    """A document with further columns whose names the operators use inside."""
    size = None if text is None else len(text)
    return (doc_id, text, "en", "s", size, 7, "r", 1, 2, 3, 0.5, 1, "w", "i")


def prose(seed, words=120):
    rng = random.Random(seed)
    parts = ["ba", "ro", "ti", "lem", "os", "Ka", "né", "du", "x.", "in,"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, repeated rows and ids, ties, copies, near copies and a very long text, with clashing columns."""
    long = prose(1, 30_000)
    near = prose(2, 300).split()
    near[150] = "other"
    texts = [
        (1, prose(2, 300)), (2, " ".join(near)), (3, prose(2, 300).upper()), (4, prose(2, 300)), (5, None), (6, ""),
        (7, " \n\t "), (8, "one"), (9, "one two"), (10, "One  two\nthree"), (None, prose(3)), (None, None), (11, long),
        (12, prose(4)), (12, prose(4)), (12, prose(5)), (13, "a " * 200), (14, "日本語 \\ </s> [INST] 'quoted'"),
        (100, prose(6)), (200, prose(7) + " " + prose(2, 300)),
    ]
    return spark.createDataFrame([row(*pair) for pair in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
