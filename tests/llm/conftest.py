import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with further columns whose names clash with the operators' own."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", 7, "x", "y") for i, t in rows], "doc_id bigint, text string, lang string, n bigint, kind string, a string")
        return df

    return make


@pytest.fixture(scope="session")
def english():
    """Reproducible prose over a small vocabulary."""
    import random

    words = "river stone cloud garden window letter market bridge winter summer teacher doctor music paper silver morning evening train station forest".split()

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(f"{r.choice(words)}{r.randrange(40)}" if r.random() < 0.6 else r.choice(words) for _ in range(n))

    return make
