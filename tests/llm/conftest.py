"""Small documents with every odd case: missing, empty, blank, very long and repeated texts, missing keys, clashing extra columns."""

from __future__ import annotations

import random

import pytest

SPEC = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, node string, score string, row string"
VOWELS = {"en": "thandofringest", "de": "schunkeitäßüver", "fr": "éleauxoismentè", "es": "ciónadoñarllos"}


def words(rng, lang, count):
    letters = VOWELS[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(count))


def odd_rows():
    """Rows of the odd cases; ids from 1,000,000."""
    extra = ("k", "s", "n", "x", "r")
    rows = [
        (1_000_000, None, None, None, None, *extra), (1_000_001, "", "en", "a", 0, *extra), (1_000_002, " \t\n", None, "a", 3, *extra),
        (1_000_003, "!!! 123 ???", "en", None, 11, *extra), (1_000_004, "lone", "en", "b", 4, *extra),
        (None, "no id but a few words here", None, "b", 26, *extra),
    ]
    return rows + [(1_000_005, "twice the very same row of words", "en", "a", 32, *extra)] * 2


@pytest.fixture(scope="session")
def doc_rows():
    rng = random.Random(5)
    rows = []
    for number in range(240):
        lang = ("en", "de", "fr", "es")[number % 4]
        text = words(rng, lang, rng.randint(60, 160))
        rows.append((number, text, lang, f"s{number % 3}", len(text), "k", "s", "n", "x", "r"))
    base = rows[0][1].split()
    rows += [(500 + i, " ".join([*base[:i], f"changed{i}", *base[i + 1 :]]), "en", "s0", 0, "k", "s", "n", "x", "r") for i in range(0, 40, 2)]
    rows += [(600 + i, rows[1][1], "de", "s1", 0, "k", "s", "n", "x", "r") for i in range(5)]
    rows.append((700, "long " + words(rng, "en", 30_000), "en", "s2", 0, "k", "s", "n", "x", "r"))
    return rows + odd_rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SPEC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SPEC)
