import random

import pytest

WORDS = "the and of stone river bright walking under letter seven garden never cloud paper window silver quiet market bridge summer".split()


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + (str(rng.randrange(90)) if rng.random() < 0.4 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names of the operators' own."""
    rows = [(1, prose(80, 1)), (1, prose(80, 1)), (2, None), (3, ""), (None, prose(60, 2)), (None, prose(60, 2)), (4, " \n\t "), (5, prose(30_000, 3)), (6, prose(80, 1)), (7, "one"), (None, None), (8, "x" * 5000)]
    extra = "n_words, failed_bits, hash, node, key, text_hash, salt, length, shard, vslot, count, _id, kind, entity, c0, c1, item_id"
    names = extra.split(", ")
    return spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
