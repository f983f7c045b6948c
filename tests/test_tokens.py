import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textguard.functions.skew import lookup_join, number_within
from textguard.operators.tokens import apply_tokens, collisions, number_values, occurrences, restore, vault
from textguard.operators.vault import vault_accesses, with_idle_epoch
from textguard.plans.redact import inspect_texts, redact_requests, redact_table, redact_texts
from textguard.policy import Policy


def test_sequential_numbers_follow_first_appearance(spark, policy):
    texts = ["b@x.com a@x.com", "a@x.com c@x.com Project Raven", "sk-abc1234567890SECRET d@x.com", "client orion b@x.com"]
    items = inspect_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), policy)
    found = occurrences(items, policy, ["id"], [])
    tokens = number_values(found, ["id"])
    got = {r.value: r.token for r in tokens.collect()}
    assert got == {
        "b@x.com": "[PRIVATE_EMAIL_001]", "a@x.com": "[PRIVATE_EMAIL_002]", "c@x.com": "[PRIVATE_EMAIL_003]",
        "Project Raven": "[CODENAME_001]", "client orion": "[CODENAME_002]",
    }
    done = apply_tokens(items, found, tokens, policy, ["id"]).orderBy("id").collect()
    assert [r.redacted for r in done] == [
        "[PRIVATE_EMAIL_001] [PRIVATE_EMAIL_002]", "[PRIVATE_EMAIL_002] [PRIVATE_EMAIL_003] [CODENAME_001]", None,
        "[CODENAME_002] [PRIVATE_EMAIL_001]",
    ]


def test_numbering_with_one_hot_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("g"), F.hash("id").alias("o"), "id"
    )
    got = number_within(df, ["g"], ["o", "id"], "n").collect()
    seen = {}
    for row in sorted(got, key=lambda r: (r.g, r.o, r.id)):
        seen[row.g] = seen.get(row.g, 0) + 1
        assert row.n == seen[row.g]


def test_lookup_join_with_hot_and_missing_keys(spark):
    facts = spark.range(30000).select((F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000)).alias("k"), "id")
    table = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup_join(facts, table, ["k"]).collect()
    assert len(got) == 30000
    assert all(r.v == (r.k * 2 if r.k < 4000 else None) for r in got)


def test_restore_is_scoped_to_the_conversation(spark, policy):
    texts = spark.createDataFrame(
        [(0, "a", "Mail bob@x.com or bob@x.com, call 212-555-1212"), (1, "b", "Mail bob@x.com"), (2, "a", "plain")],
        "id int, conversation string, text string",
    )
    done = redact_texts(texts, policy, F.col("conversation"), "k")
    ledger = vault(occurrences(done, policy, ["id"], ["conversation"]), "k", "conversation")
    assert ledger.count() == 2 and collisions(ledger).collect() == []
    sent = done.select("id", "conversation", F.col("redacted").alias("text"))
    back = {r.id: r.restored for r in restore(sent, ledger, "id").collect()}
    assert back == {0: "Mail bob@x.com or bob@x.com, call [PRIVATE_PHONE_REDACTED]", 1: "Mail bob@x.com", 2: "plain"}
    elsewhere = restore(sent.withColumn("conversation", F.lit("z")), ledger, "id")
    assert elsewhere.where(~F.col("restored").eqNullSafe(F.col("text"))).collect() == []
    unknown = spark.createDataFrame([(0, "a", "Email [PRIVATE_EMAIL_deadbeefdeadbeef]")], sent.schema)
    assert restore(unknown, ledger, "id").first().restored == "Email [PRIVATE_EMAIL_deadbeefdeadbeef]"


def test_two_values_under_one_token_are_reported(spark):
    ledger = spark.createDataFrame(
        [("c", 0, "t", "x", "1"), ("c", 0, "t", "x", "2"), ("d", 0, "t", "x", "1")],
        "conversation string, epoch long, token string, category string, value string",
    )
    assert [(r.conversation, r.n_values) for r in collisions(ledger).collect()] == [("c", 2)]


START = datetime(2024, 1, 1)


def accesses(spark, rows):
    df = spark.createDataFrame([(c, START + timedelta(seconds=s), i) for i, (c, s) in enumerate(rows)], "c string, ts timestamp, i long")
    return df.repartition(5)


def simulate(rows, ttl, cap):
    live, lives, out = OrderedDict(), {}, []
    for c, s in rows:
        for gone in [k for k, last in live.items() if s - last > ttl]:
            del live[gone]
        hit = c in live
        if not hit:
            lives[c] = lives.get(c, -1) + 1
        live[c] = s
        live.move_to_end(c)
        while len(live) > cap:
            live.popitem(last=False)
        out.append((hit, lives[c]))
    return out


def test_vault_equals_simulation(spark):
    rnd = random.Random(9)
    for ttl, cap, users, n in [(10, 1, 3, 300), (50, 4, 12, 2000), (10**6, 5, 60, 2000), (3, 100, 5, 500), (10**6, 100, 20, 800)]:
        # One conversation makes a third of all accesses; several accesses share a time.
        rows, now = [], 0
        for _ in range(n):
            now += rnd.choice([0, 0, 1, 2, 7])
            rows.append(("hot" if rnd.random() < 0.33 else f"u{rnd.randrange(users)}", now))
        got = vault_accesses(accesses(spark, rows), "c", "ts", "i", ttl, cap).orderBy("i").collect()
        assert [(r.hit, r.epoch) for r in got] == simulate(rows, ttl, cap), (ttl, cap)


def test_time_out_is_strict(spark):
    rows = [("old", 1000), ("new", 1001), ("recent", 1001), ("recent", 1012)]
    got = vault_accesses(accesses(spark, rows), "c", "ts", "i", 10, 1).orderBy("i").collect()
    assert [r.hit for r in got] == [False, False, False, False]
    edge = accesses(spark, [("a", 0), ("a", 10), ("a", 21), ("b", 3)])
    assert [r.epoch for r in with_idle_epoch(edge, "c", "ts", 10).orderBy("i").collect()] == [0, 0, 1, 0]


def test_idle_epochs_equal_simulation(spark):
    rnd = random.Random(11)
    rows, now = [], 0
    for _ in range(3000):
        now += rnd.choice([0, 1, 5, 30])
        rows.append((f"u{rnd.randrange(20)}" if rnd.random() < 0.6 else "hot", now))
    got = with_idle_epoch(accesses(spark, rows), "c", "ts", 60).orderBy("i").collect()
    assert [r.epoch for r in got] == [e for _, e in simulate(rows, 60, 10**9)]


def test_sequential_mode_of_a_policy(spark):
    use = Policy.builtin()
    use.tokenization.mode = "deterministic"
    texts = spark.createDataFrame([(1, "b@x.com"), (0, "a@x.com b@x.com"), (2, "fine")], "id int, text string")
    with pytest.raises(ValueError):
        redact_texts(texts, use, F.lit("c"))
    got = {r.id: r.redacted for r in redact_table(texts, use, ["id"], F.lit("c")).collect()}
    assert got == {0: "[PRIVATE_EMAIL_001] [PRIVATE_EMAIL_002]", 1: "[PRIVATE_EMAIL_002]", 2: "fine"}
    payloads = texts.select(
        F.col("id").alias("request_id"), F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("messages"))).alias("payload")
    )
    done = {r.request_id: r.redacted_payload for r in redact_requests(payloads, use).collect()}
    assert done[0] == '{"messages":[{"content":"[PRIVATE_EMAIL_001] [PRIVATE_EMAIL_002]"}]}'
    assert done[1] == '{"messages":[{"content":"[PRIVATE_EMAIL_002]"}]}'


def test_times_without_zone_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        # The clock change of that night is not an hour without access.
        rows = [("a", datetime(2024, 3, 31, 1, 50), 0), ("a", datetime(2024, 3, 31, 3, 10), 1)]
        df = spark.createDataFrame(rows, "c string, ts timestamp_ntz, i long")
        assert [r.epoch for r in with_idle_epoch(df, "c", "ts", 3600).orderBy("i").collect()] == [0, 1]
        got = vault_accesses(df, "c", "ts", "i", 3600, 5).orderBy("i").collect()
        assert [(r.hit, r.ts) for r in got] == [(False, rows[0][1]), (False, rows[1][1])]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
