import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from textguard.session import local_session

    session = local_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def policy():
    from textguard.policy import Policy

    return Policy.builtin()


@pytest.fixture
def redact(spark, policy):
    """Run texts through the whole text pipeline; rows in input order."""
    from pyspark.sql import functions as F

    from textguard.plans.redact import redact_texts

    def run(texts, use=policy, conversation="c", key="k"):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        return redact_texts(df, use, F.lit(conversation), key).orderBy("id").collect()

    return run
