import pytest

from adlens.llm.ship import send_package

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs."""
    send_package(spark)

    def build(rows, partitions=3):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)
    return build


@pytest.fixture
def words():
    """Invented words from a seed."""
    import random

    def make(n, seed, vocabulary=5000):
        own = random.Random(seed)
        return [f"w{own.randrange(vocabulary)}" for _ in range(n)]
    return make
