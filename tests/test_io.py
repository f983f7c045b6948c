import json

import pytest
from pyspark.sql import functions as F

from textguard.operators.reports import case_report, markdown_lines, report_header, size_stats
from textguard.plans.redact import redact_requests
from textguard.sources.readers import (
    mask_headers,
    read_captures,
    read_fixtures,
    read_hits,
    read_payloads,
    read_texts,
    spread,
    stream_payloads,
)
from textguard.sources.sinks import write_requests
from textguard.streaming.requests import redact_request_stream, redact_text_stream
from textguard.streaming.vault import life_stream, redact_life_stream

RAW = "alice@example.com"


def lines(*contents):
    return "\n".join(json.dumps({"messages": [{"role": "user", "content": c}]}) for c in contents) + "\n"


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(lines("one", "two"))
    rows = read_payloads(spark, str(tmp_path)).collect()
    assert len({r.request_id for r in rows}) == 2 and rows[0].source_file.endswith("a.jsonl")
    again = read_payloads(spark, str(tmp_path)).collect()
    assert {r.request_id for r in rows} == {r.request_id for r in again}
    (tmp_path / "b.json").write_text('{\n "messages": []\n}')
    assert read_payloads(spark, str(tmp_path / "b.json"), whole_files=True).count() == 1


def test_fixture_directory(spark, tmp_path):
    for name in ("b", "a"):
        case = {"name": name, "payload": {"z": 1, "messages": [{"content": RAW}]}, "expect_allowed": True, "must_contain": ["X"]}
        (tmp_path / f"{name}.json").write_text(json.dumps(case, indent=1))
    rows = read_fixtures(spark, str(tmp_path)).orderBy("source_file").collect()
    assert [r.name for r in rows] == ["a", "b"] and json.loads(rows[0].payload)["messages"][0]["content"] == RAW


def test_captures_and_headers(spark, tmp_path):
    event = {"method": "POST", "url": "u", "headers": {"Authorization": "Bearer s", "X-API-Key": "k", "accept": "a"}, "body": "b"}
    (tmp_path / "c.jsonl").write_text(json.dumps(event) + "\n")
    captures = read_captures(spark, str(tmp_path))
    assert captures.first().headers == {"Authorization": "[redacted]", "X-API-Key": "[redacted]", "accept": "a"}
    assert mask_headers(captures, keep_others=False).first().headers == {"Authorization": "[redacted]", "X-API-Key": "[redacted]"}


def test_landed_hits(spark, tmp_path):
    row = {"id": "7", "response": '{"findings":[{"label":"secret","start":0,"end":2}]}'}
    (tmp_path / "h.jsonl").write_text(json.dumps(row) + "\n")
    assert [tuple(r) for r in read_hits(spark, str(tmp_path), "id").collect()] == [("7", "secret", 0, 2, None)]


def test_text_tables_scan_two_columns_and_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).select("id", F.lit("x").alias("text"), F.lit("y").alias("other")).coalesce(1).write.parquet(path)
    texts = read_texts(spark, path, "id", "text")
    assert texts.count() == 50 and texts.rdd.getNumPartitions() > 1
    assert "other" not in texts._jdf.queryExecution().executedPlan().toString()
    # The setting decides, not the size of the scan.
    wanted = spark.conf.get("spark.textguard.scan.partitions")
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id").rdd.getNumPartitions() == int(wanted)
    spark.conf.unset("spark.textguard.scan.partitions")
    try:
        assert spread(wide, "id") is wide
    finally:
        spark.conf.set("spark.textguard.scan.partitions", wanted)


def test_batch_sinks(spark, policy, tmp_path):
    (tmp_path / "in.jsonl").write_text(lines(f"mail {RAW}", "Use sk-abc1234567890SECRET", "fine"))
    done = redact_requests(read_payloads(spark, str(tmp_path / "in.jsonl")), policy, "k")
    write_requests(done, str(tmp_path / "out"))
    allowed = spark.read.parquet(str(tmp_path / "out/allowed"))
    assert allowed.count() == 2 and not any(RAW in r.redacted_payload for r in allowed.collect())
    kept = spark.read.parquet(str(tmp_path / "out/quarantine")).collect()
    assert [r.blocked_categories for r in kept] == [["api_key"]]
    audit = spark.read.parquet(str(tmp_path / "out/audit"))
    assert {r.action for r in audit.collect()} == {"tokenize", "block"} and "value" not in audit.columns


def test_request_stream_and_replayed_batch(spark, policy, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text(lines(f"mail {RAW}", "Use sk-abc1234567890SECRET"))
    out = str(tmp_path / "out")

    def run():
        redact_request_stream(stream_payloads(spark, str(tmp_path / "in")), policy, out, str(tmp_path / "ck"), "k").awaitTermination()

    run()
    (tmp_path / "in/2.jsonl").write_text(lines("fine", "{"))
    run()
    allowed = spark.read.parquet(f"{out}/allowed")
    assert allowed.count() == 3 and RAW not in json.dumps([r.redacted_payload for r in allowed.collect()])
    assert spark.read.parquet(f"{out}/quarantine").count() == 1
    assert spark.read.parquet(f"{out}/audit").count() == 2


def test_text_stream(spark, policy, tmp_path):
    spark.createDataFrame([(1, f"mail {RAW}"), (2, "alice at example dot com")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    done = redact_text_stream(stream, policy, F.lit("c"), "k").select("id", "allowed", "redacted")
    query = done.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    query.start(str(tmp_path / "out"), format="parquet").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and all(r.redacted.count("[PRIVATE_EMAIL_") == 1 for r in rows)


@pytest.fixture
def rocksdb(spark):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(setting, before)


def run_lives(spark, folder, batches, make):
    """Land batches of (conversation, id, second, text) one by one, and run a stream over each on one checkpoint."""
    for rows in batches:
        df = spark.createDataFrame(rows, "c string, i long, s long, text string")
        df.select("c", "i", F.timestamp_seconds("s").alias("ts"), "text").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("c string, i long, ts timestamp, text string").parquet(f"{folder}/in")
        run = make(stream).writeStream.option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True)
        run.start(f"{folder}/out", format="parquet").awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def states(spark, folder, name):
    return spark.read.format("statestore").option("path", f"{folder}/ck").option("stateVarName", name).load()


def test_lives_in_event_time(spark, tmp_path, rocksdb):
    first = [("a", 1, 100, "x"), ("b", 2, 101, None), ("a", 3, 118, "y"), ("a", 4, 105, "z")]
    second = [("a", 5, 111, "w"), ("b", 6, 112, "v"), ("a", 7, 140, "u")]  # 5 closes the gap between 4 and 3
    beat, late = [("beat", 0, 10_000, None)], [("a", 8, 119, "late"), ("c", 9, 9_995, "in time")]
    make = lambda stream: life_stream(stream, "c", "ts", 10, "30 seconds", ("i", "text"))
    rows = run_lives(spark, tmp_path, [first, second, beat, late], make)
    want = {1: 100, 4: 100, 5: 100, 3: 100, 7: 140, 2: 101, 6: 112}
    assert {r.i: r.life for r in rows if not r.late} == {k: v * 1_000_000 for k, v in want.items()}
    assert [(r.i, r.life, r.text) for r in rows if r.late] == [(8, None, "late")]
    assert {r.i: r.text for r in rows if not r.late}[2] is None
    # All lives have timed out: what is left waits for the watermark.
    assert states(spark, tmp_path, "life").count() == 0
    waiting = states(spark, tmp_path, "waiting").select("key.conversation").collect()
    assert sorted(r.conversation for r in waiting) == ["beat", "c"]


def test_lives_do_not_depend_on_batches(spark, tmp_path, rocksdb):
    import random

    from textguard.operators.vault import with_life

    draw = random.Random(4)
    rows = [(f"c{draw.randrange(4)}", k, 1000 + draw.randrange(400), "t") for k in range(200)]
    df = spark.createDataFrame(rows, "c string, i long, s long, text string").withColumn("ts", F.timestamp_seconds("s"))
    want = {r.i: r.life for r in with_life(df, "c", "ts", 12).collect()}
    make = lambda stream: life_stream(stream, "c", "ts", 12, "500 seconds", ("i",))
    for n, cut in enumerate((50, 200)):
        draw.shuffle(rows)
        batches = [rows[k : k + cut] for k in range(0, 200, cut)] + [[("beat", None, 99_999, None)]]
        got = run_lives(spark, tmp_path / str(n), batches, make)
        assert {r.i: r.life for r in got} == want and not any(r.late for r in got)


def test_tokens_of_a_stream_belong_to_a_life(spark, policy, tmp_path, rocksdb):
    mail = "mail a@b.com"
    batches = [[("a", 1, 100, mail), ("a", 2, 105, mail), ("b", 3, 100, mail)], [("a", 4, 100_000, mail)], [("z", 5, 900_000, "")], [("a", 6, 90, mail)]]
    make = lambda s: redact_life_stream(s, policy, "c", "ts", "1 minute", "k", carry=("i",)).select("i", "late", "redacted")
    got = {r.i: r.redacted for r in run_lives(spark, tmp_path, batches, make)}
    assert got[1] == got[2] and len({got[1], got[3], got[4], got[6]}) == 4 and "a@b.com" not in "".join(got.values())


def test_reports(spark, policy):
    shape = "id string, allowed boolean, blocked_categories array<string>, n_findings int, redacted_payload string"
    requests = spark.createDataFrame([("b", False, ["api_key", "jwt"], 2, None), ("a", True, [], 0, "{}")], shape)
    report = case_report(requests, "id")
    assert sorted(tuple(r) for r in report.collect()) == [("a", True, "-", 0, "{}"), ("b", False, "api_key, jwt", 2, "[blocked locally]")]
    text = [r.value for r in markdown_lines(report, policy).collect()]
    assert text[-2:] == ["| a | true | - | 0 |", "| b | false | api_key, jwt | 2 |"] and "- profile: security_consulting" in text
    assert report_header(policy)["mode"] == "enforce"
    texts = spark.createDataFrame([("g", "é"), ("g", "abc"), ("g", "abcde")], "g string, text string")
    assert tuple(size_stats(texts, ["g"]).first()) == ("g", 3, 10, 3.0, 5)
    assert size_stats(texts, ["g"], exact=False).first().median_bytes == 3.0
