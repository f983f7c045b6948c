import json

from pyspark.sql import functions as F

from textguard.operators.hits import attach_hits, detect_hits
from textguard.operators.reports import known_categories, roll_up
from textguard.plans.redact import audit_table, inspect_texts, redact_texts
from textguard.policy import Policy
from textguard.sources.readers import hits_from_json


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def audit_of(spark, policy, *texts):
    return audit_table(inspect_texts(frame(spark, *texts), policy), policy, ["id"]).collect()


def test_audit_only_policy_changes_and_blocks_nothing(spark, redact):
    text = "Use sk-abc1234567890SECRET and email alice@example.com"
    for change in ({"audit_only": True}, {"mode": "audit"}, {"mode": "dry-run"}):
        use = Policy.builtin()
        for name, value in change.items():
            setattr(use, name, value)
        row = redact([text], use)[0]
        assert row.allowed and row.redacted == text and row.blocked_categories == []
        records = audit_of(spark, use, text)
        assert len(records) >= 2 and all(r.audit_only and r.policy_hash == use.fingerprint() for r in records)
        assert "alice@example.com" not in json.dumps([r.asDict() for r in records])


def test_rule_audit_only_mixes_with_enforced_rules(spark, redact):
    use = Policy.builtin()
    use.rules = use.rules + [
        {"id": "employee", "type": "keyword", "values": ["Alice Example"], "category": "private_person", "audit_only": True}
    ]
    row = redact(["Alice Example uses sk-abc1234567890SECRET", "Alice Example here"], use)
    assert not row[0].allowed and "api_key" in row[0].blocked_categories
    assert row[1].allowed and row[1].redacted == "Alice Example here"
    assert any(r.rule_id == "employee" and r.audit_only for r in audit_of(spark, use, "Alice Example uses sk-abc1234567890SECRET"))


def test_unsafe_findings_have_a_reason(spark, policy):
    records = audit_of(spark, policy, "j0hn d0e at ex@mpl3 dot com", "bob@x.com")
    assert [r.reason is not None for r in records] == [True, False]


def test_outside_hits(spark):
    use = Policy.builtin()
    use.detectors.privacy_filter = "enabled"
    hits = spark.createDataFrame(
        [(0, "private_person", 0, 13, None), (0, "private_person", 0, 13, None), (0, "weather", 0, 2, 1.0), (1, "secret", 3, None, 1.0),
         (1, "account_number", 0, 99, 0.5)],
        "id int, label string, start int, end int, score double",
    )
    items = attach_hits(frame(spark, "Alice Example", "Bob"), hits, "id")
    rows = redact_texts(items, use, F.lit("c"), "k", hits="hits").orderBy("id").collect()
    assert rows[0].redacted.startswith("[PRIVATE_PERSON_") and rows[0].redacted.endswith("]")
    assert [(f.category, f.confidence, f.severity) for f in rows[0].resolved] == [("private_person", 1.0, "high")]
    assert rows[1].blocked_categories == ["account_number"]
    off = redact_texts(items, Policy.builtin(), F.lit("c"), "k", hits="hits").orderBy("id").collect()
    assert off[0].redacted == "Alice Example"


def test_detector_inside_the_job(spark):
    import pandas as pd
    from pyspark.sql import types as T

    hit = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(T.ArrayType(hit))
    def names(texts: pd.Series) -> pd.Series:
        def one(text):
            at = text.find("Alice")
            bad = [{"label": "other", "start": 0, "end": 1, "score": 1.0}, {"label": "secret", "start": 2, "end": 1, "score": 1.0}]
            return bad + ([{"label": "private_person", "start": at, "end": at + 5, "score": None}] if at >= 0 else [])

        return pd.Series([one(t) for t in texts])

    use = Policy.builtin()
    use.detectors.privacy_filter = True
    rows = redact_texts(detect_hits(frame(spark, "see Alice", "Bob"), names), use, F.lit("c"), "k", hits="hits").orderBy("id").collect()
    assert rows[0].redacted.startswith("see [PRIVATE_PERSON_") and rows[1].redacted == "Bob"


def test_functions_by_name(spark):
    from textguard.functions.register import register

    assert "obfuscated_spans" in register(spark)
    row = spark.sql("SELECT obfuscated_spans('alice at example dot com')[0].category AS c, json_leaves('{\"a\":[\"x\"]}')[0].text AS t").first()
    assert (row.c, row.t) == ("private_email", "x")


def test_hit_responses_of_both_shapes(spark):
    one = '{"findings":[{"label":"private_email","start":6,"end":23,"score":0.99},{"start":1}]}'
    two = ' [{"label":"secret","start":0,"end":2}]'
    df = spark.createDataFrame([(one,), (two,), ("{}",)], "r string")
    got = [r.h for r in df.select(hits_from_json(F.col("r")).alias("h")).collect()]
    assert [(h.label, h.start, h.end, h.score) for h in got[0]] == [("private_email", 6, 23, 0.99), (None, 1, None, None)]
    assert [(h.label, h.score) for h in got[1]] == [("secret", None)] and got[2] is None


def test_roll_up(spark, policy):
    texts = frame(spark, "sk-abc1234567890SECRET", "acct", "bob@x.com", "fine").withColumn("g", F.col("id") % 2)
    rows = roll_up(inspect_texts(texts, policy), ["g"], policy).orderBy("g").collect()
    assert [(r.allowed, r.blocked_categories, r.n_findings) for r in rows] == [(False, ["api_key"], 2), (True, [], 0)]
    assert {"api_key", "obfuscated_text", "client_codename"} <= set(known_categories(policy))


def test_tokens_depend_on_conversation_and_key(redact):
    texts = ["mail bob@x.com and bob@x.com", "bob@x.com"]
    a, b = redact(texts, conversation="a"), redact(texts, conversation="b")
    again, other_key = redact(texts, conversation="a"), redact(texts, conversation="a", key="z")
    token = a[1].redacted
    assert a[0].redacted == f"mail {token} and {token}" and again[1].redacted == token
    assert token != b[1].redacted and token != other_key[1].redacted
