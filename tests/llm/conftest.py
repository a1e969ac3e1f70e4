import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Make a DataFrame of (doc_id, text) with other columns beside, some of names that operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, node long, n long, token long, pivot string, words string, share int"
        return spark.createDataFrame([(i, t, 1, 2, 3, "p", "w", 4) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of random words, from a seed."""

    def make(n, words, seed=0, vocabulary=400):
        rnd = random.Random(seed)
        known = ["".join(rnd.choice("abcdeéñß") for _ in range(rnd.randint(2, 7))) for _ in range(vocabulary)]
        return [" ".join(rnd.choice(known) for _ in range(words)) for _ in range(n)]

    return make
