"""Awkward documents: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, row bigint, id string, body string, digest string, key bigint, label string, "
    "n_words bigint, kept boolean, chunk int, shard int, words string"
)


def words(rng, n, kinds):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """texts -> DataFrame with columns named like the operators' own."""

    def make(rows):
        full = [(i, t, 7, None, "x", None, None, "y", 3, None, 1, None, "z") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    long = words(rng, 30_000, 4000)
    base = [words(rng, rng.randrange(1, 80), 300) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 7]) for k in range(30)]  # copies
    rows += [(200 + k, base[k].upper()) for k in range(5)]
    rows += [(300, None), (301, ""), (302, "   \n"), (303, "!!! ..."), (304, None), (305, "é É ß İ K漢字 😀"), (306, "\x00\x7f")]
    rows += [(400, long), (401, long + " end"), (402, "x" * 5000)]
    rows += [(None, base[3]), (None, "no id"), (500, base[9]), (500, base[9]), (501, "same id"), (501, "other text")]
    return rows


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
