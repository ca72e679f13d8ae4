import random

import pytest


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Null, empty and very long texts, exact and near copies, repeated rows, ties, a null doc_id."""
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(12)]
    rows = [(i * 2 - 3, t) for i, t in enumerate(base)]
    rows += [(100, base[0]), (101, base[0] + " tail"), (102, base[1][:300] + " mid " + base[2][200:]), (103, None), (104, ""), (105, " \t\n "), (106, "one two")]
    rows += [(107, prose(rng, 30_000) + " " + base[3]), (108, ("aa " * 700) + base[4]), (108, base[5]), (109, base[6]), (109, base[6]), (None, base[7] + "\nlast"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The rows as documents, with columns whose names operators might use themselves."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, runs int, fingerprint int, size int, _key int, _n int, rank int, score string, target string"
    rows = [(d, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s10"][i % 4], None, 7, "k", 1, 2, 3, 4, 5, 6, "x", None) for i, (d, t) in enumerate(hard_rows)]
    return spark.createDataFrame(rows, kinds).repartition(3)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.where("false")
