import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Names that operators use inside, or that their results have.
CLASHING = ("_row", "base", "spans", "score", "key", "shard", "slot", "digest", "leaks", "_bucket", "n_words", "size")


@pytest.fixture
def docs(spark):
    """Make ``doc_id, text`` plus clashing extra columns from texts or (id, text) pairs."""

    def make(rows, extra=True):
        from pyspark.sql import functions as F

        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
        return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df

    return make


@pytest.fixture
def prose():
    """A seeded source of made-up prose."""
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(900)]

    def make(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    make.draw = draw
    return make
