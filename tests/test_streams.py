"""Streamed queries on tables that are folders of files."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

import __spark_entry__ as entry_points
from textguard.streaming.vault import EventTimeLives


@pytest.fixture
def folder(spark, tmp_path):
    texts = [(i, f"mail user{i}@example.com from 10.1.2.{i}" if i % 2 else "nothing here") for i in range(40)]
    docs = spark.createDataFrame(texts + [(40, None)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(i, i % 3, "user", f"turn {i}") for i in range(40)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    return str(tmp_path)


def test_redact_stream_of_a_folder(spark, folder):
    rows = {r["id"]: r for r in entry_points.queries()["stream_redact"](spark, folder).collect()}
    assert len(rows) == 41
    assert rows[1]["redacted"] == "mail [PRIVATE_EMAIL_REDACTED] from [IP_ADDRESS_REDACTED]"
    assert rows[2]["redacted"] == "nothing here"


def test_request_stream_of_a_folder(spark, folder):
    rows = [tuple(r) for r in entry_points.queries()["stream_requests"](spark, folder).orderBy("request_id").collect()]
    assert [r[0] for r in rows] == sorted(i * 1000 + i % 3 for i in range(40))
    assert {sink for _, sink in rows} == {"allowed", "quarantine"}


_TURN = "conv_id bigint, turn bigint, role string, text string"


def test_request_stream_of_other_layouts(spark, tmp_path):
    """A table of subfolders, one without rows, and one file beside tables that are folders."""
    requests = entry_points.queries()["stream_requests"]
    turns = spark.createDataFrame([(i, i % 3, "user", f"turn {i}") for i in range(40)], _TURN)
    turns.withColumn("part", turns.conv_id % 4).write.partitionBy("part").parquet(f"{tmp_path}/nested/conversations.parquet")
    assert requests(spark, f"{tmp_path}/nested").count() == 40
    spark.createDataFrame([], _TURN).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    empty = requests(spark, f"{tmp_path}/empty")
    assert empty.count() == 0 and empty.columns == ["request_id", "sink"]
    turns.toPandas().to_parquet(f"{tmp_path}/empty/one.parquet")
    (tmp_path / "mixed").mkdir()
    (tmp_path / "empty/one.parquet").rename(tmp_path / "mixed/conversations.parquet")
    turns.write.parquet(f"{tmp_path}/mixed/documents.parquet")
    assert requests(spark, f"{tmp_path}/mixed").count() == 40


def test_a_conversation_makes_few_state_calls():
    """Per batch and conversation, whatever the number of accesses, as every call goes over a socket."""
    calls = []

    class Store:
        def __init__(self):
            self.value, self.timers = None, set()

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name == "get":
                    return iter(self.value or []) if isinstance(self.value, list) or self is store["waiting"] else self.value
                if name == "listTimers":
                    return iter(sorted(self.timers))
                if name in ("registerTimer", "deleteTimer"):
                    (self.timers.add if name == "registerTimer" else self.timers.discard)(*given)
                elif name == "appendValue":
                    self.value = [*(self.value or []), *given]
                else:
                    self.value = None if name == "clear" else given[0]

            return call

    class At:
        def __init__(self, seconds):
            self.seconds = seconds

        def getCurrentWatermarkInMs(self):
            return self.seconds * 1000

    store = {"waiting": Store(), "life": Store(), "timers": Store()}
    handle = store["timers"]
    handle.getListState = lambda name, shape: store[name]
    handle.getValueState = lambda name, shape: store[name]
    lives = EventTimeLives(10, [("i", "bigint")])
    lives.init(handle)
    accesses = [Row(at=(100 + k % 50) * 1_000_000, i=k) for k in range(900)]
    assert list(lives.handleInputRows(("a",), iter(accesses), At(0))) == [] and len(calls) <= 3
    calls.clear()
    out = list(lives.handleExpiredTimer(("a",), At(120), None))
    assert len(out) == 360 and {r.life for r in out} == {100_000_000} and len(calls) <= 5
    calls.clear()
    late = list(lives.handleInputRows(("a",), iter([Row(at=1, i=None), Row(at=200_000_000, i=2**60 + 1)]), At(120)))
    assert [(r.i, r.life, r.late) for r in late] == [(None, None, True)]
    out += lives.handleExpiredTimer(("a",), At(300), None)
    assert len(out) == 901 and out[-1].i == 2**60 + 1 and out[-1].life == 200_000_000 and out[-2].life == 100_000_000
    assert store["waiting"].value is None and store["life"].value is None
