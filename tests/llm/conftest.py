import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_df(spark):
    """Rows (doc_id, text[, source]) as a documents table."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def prose():
    """Texts of random words over a small invented vocabulary."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4)))
                  for _ in range(400)]

    def text(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join(r.choice(vocabulary) for _ in range(n))
    return text
