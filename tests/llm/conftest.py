"""Small documents with every awkward case: nulls, empty and white texts, a very long text, copies, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken string, kept string, rank int, id string"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("the", "an", "of", "st") for b in ("ing", "tion", "er", "ly") for c in ("a", "o", "re", "ble", "nd")] + ["the", "of", "and", "to", "in"] * 6
    out = []
    for i in range(60):
        out.append((i, prose(rng, rng.randint(60, 200), words), ("en", "fr", None)[i % 3], f"src{i % 4}"))
    base = out[5][1].split()
    for k in range(8):  # near copies: two words changed
        w = list(base)
        w[3 + k], w[30 + k] = "changed", f"other{k}"
        out.append((100 + k, " ".join(w), "en", "src0"))
    out += [(200 + k, out[7][1], "en", "src1") for k in range(5)]  # copies
    out += [(300, None, "en", "src2"), (301, "", None, None), (302, " \t\n", "en", None), (303, "one two", "fr", "src3"), (304, "!!! ### 123", "en", "src3")]
    out += [(400, prose(rng, 40_000, words), "en", "src2")]  # very long
    out += [out[2], out[2]]  # repeated rows
    out += [(None, prose(rng, 80, words), "en", None)]
    return [(i, t, lang, s, None if t is None else len(t), "x", None, 1, "y") for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
