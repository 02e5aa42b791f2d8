import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, rank string, block long, key string"


def make_docs(spark, rows):
    """Documents with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, 9.0, 3, "x", 1, "k") for i, t, s in rows], DOCS)


def sentences(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "été", "x1", "omega", "zeta", "eta", "theta"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [(i, sentences(i, 5 + 7 * i % 60), f"s{i % 3}") for i in range(40)]
    rows += [(40, None, "s0"), (41, "", "s1"), (42, "  \n\t ", None), (43, sentences(3, 24), "s1"), (43, sentences(3, 24), "s1"), (44, sentences(5, 20_000), "s2"), (45, "w" * 300_000, "s2"), (46, "one two", "s2"), (None, "no id here at all", "s0"), (-5, sentences(3, 24), "s0"), (47, "\x00 nul　wide <|endoftext|> tail", "s0")]
    return rows


@pytest.fixture
def odd_docs(spark, odd_rows):
    return make_docs(spark, odd_rows)


@pytest.fixture
def no_docs(spark):
    return make_docs(spark, [])
