"""Inputs that once let raw values through or stopped the job."""

import json

import pytest
from pyspark.sql import functions as F

from textguard.operators.extract import is_json_text, strict_json, write_back
from textguard.operators.hits import hit_findings
from textguard.plans.redact import redact_requests
from textguard.policy import Policy

VALUE = "alice@example.com"


@pytest.fixture(scope="module")
def plain_policy():
    policy = Policy.builtin()
    policy.detectors.normalization = False
    return policy


def requests(spark, *payloads):
    return spark.createDataFrame([(str(k), p) for k, p in enumerate(payloads)], "request_id string, payload string")


def test_only_whole_strings_are_json(spark):
    good = ['{"a":1}', ' [1, null] ', '{"a":"]}"}', "[]", "{}", '{"a":[{"b":null}]}']
    bad = ['{"a":1} {"b":2}', '{"a":1} x', '{"a":1}] y', '{"a":1}} y', '{"a":1},{"b":1}', '{"a":1},1]', "[1] note", "[1]]", "{", "", "x"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").coalesce(1)
    got = df.select("t", (strict_json(F.col("t")).isNotNull() & is_json_text(F.col("t"))).alias("ok")).collect()
    assert {r.t for r in got if r.ok} == set(good)


def test_text_after_a_request_is_not_let_through(spark, plain_policy):
    rows = redact_requests(requests(spark, '{"content":"hi"} {"content":"%s"}' % VALUE, '{"content":"hi"} %s' % VALUE), plain_policy, "k")
    assert all(not r.allowed and r.problem == "malformed" and r.redacted_payload is None for r in rows.collect())


def test_footnotes_are_plain_text(spark, plain_policy):
    payload = json.dumps({"messages": [{"content": f"[1] write {VALUE}"}]})
    row = redact_requests(requests(spark, payload), plain_policy, "k").first()
    assert row.allowed and VALUE not in row.redacted_payload and "[1] write [PRIVATE_EMAIL_" in row.redacted_payload


def test_a_payload_that_cannot_be_rewritten_gives_null(spark):
    path = "array<struct<path:array<struct<key:string,pos:int>>,text:string,json_encoded:boolean>>"
    df = spark.sql(f"SELECT '{{' AS p, CAST(array(named_struct('path', array(named_struct('key', 'a', 'pos', NULL)), 'text', 'x', 'json_encoded', false)) AS {path}) AS e")
    assert df.select(write_back("p", "e").alias("r")).first().r is None


def test_equal_lines_report_their_findings_once_each(spark, plain_policy):
    payload = json.dumps({"content": VALUE})
    df = spark.createDataFrame([("same", payload)] * 3, "request_id string, payload string")
    assert [r.n_findings for r in redact_requests(df, plain_policy, "k").collect()] == [1, 1, 1]


def test_empty_hits_are_not_used_and_overlong_ones_end_with_the_text(spark):
    from textguard.operators.hits import attach_hits, usable_hits

    person = "private_person"
    hits = [(person, 5, 5, 1.0), (person, 0, 99, 1.0), (person, 3, 2, 1.0), (person, 0, 4, 1.0), (person, 6, 9, 1.0), (person, -1, 3, 1.0)]
    df = spark.createDataFrame([("mail x", hits)], "text string, hits array<struct<label:string,start:int,end:int,score:double>>")
    found = df.select(hit_findings(F.col("hits"), F.col("text")).alias("f")).first().f
    assert [(f.start, f.end, f.value) for f in found] == [(0, 6, "mail x"), (0, 4, "mail")]
    # The table of usable hits says the same.
    table = spark.createDataFrame([(7, *h) for h in hits], "id int, label string, start int, end int, score double")
    items = spark.createDataFrame([(7, "mail x"), (8, None)], "id int, text string")
    assert sorted((r.start, r.end) for r in usable_hits(table, items, "id").collect()) == [(0, 4), (0, 6)]
    assert sorted((f.start, f.end) for r in attach_hits(items, table, "id").collect() for f in r.hits) == [(0, 4), (0, 6)]
