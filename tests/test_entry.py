"""Every registered query against its check SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def canonical(rows, names):
    def one(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 6)
        return value if value is None or isinstance(value, (int, str, bool)) else str(value)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    result = entry_points.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in result.collect()]
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    names = [column[0] for column in answer.description]
    assert sorted(names) == sorted(result.columns)
    assert canonical(rows, result.columns) == canonical(answer.fetchall(), names)
