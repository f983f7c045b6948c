import json

from pyspark.sql import functions as F

from textguard.operators.checks import escaped_requests, leaks, replay_failures
from textguard.operators.extract import (
    compact_json,
    conversation_key,
    extract_items,
    override_model,
    override_model_in_payload,
    parse_payloads,
    path_text,
)
from textguard.plans.redact import quarantine, redact_requests

EMAIL, ADDRESS, CODENAME = "alice@example.com", "10.9.8.7", "Project Raven"
ARGUMENTS = '{"email": "alice@example.com", "ip": "10.9.8.7", "n": 1.0, "s": "a  b"}'


def chat(content):
    return {"model": "mock", "messages": [{"role": "user", "content": content}]}


def payloads(spark, *documents):
    rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "request_id int, payload string")


def run(spark, policy, *documents):
    return redact_requests(payloads(spark, *documents), policy, "k").orderBy("request_id").collect()


def test_all_payload_shapes_are_rewritten(spark, policy):
    documents = [
        chat(f"{EMAIL} {ADDRESS} {CODENAME}"),
        chat([{"type": "text", "text": f"Email {EMAIL}"}, {"type": "text", "text": f"IP {ADDRESS}"}]),
        {"instructions": f"No {CODENAME}", "input": [{"role": "u", "content": [{"type": "input_text", "text": EMAIL}]}],
         "metadata": {"ticket": f"source {ADDRESS}"}},
        {"system": f"note {CODENAME}", "developer": f"contact {EMAIL}", "messages": [{"content": f"IP {ADDRESS}"}]},
        {"messages": [{"tool_calls": [{"function": {"name": "lookup", "arguments": ARGUMENTS}}]},
                      {"role": "tool", "content": f"output for {CODENAME}"}],
         "mcp": {"tool_result": {"content": [{"type": "text", "text": EMAIL}]}}},
    ]
    for row, document in zip(run(spark, policy, *documents), documents):
        assert row.allowed and row.problem is None and row.n_findings >= 2
        for raw in (EMAIL, ADDRESS, CODENAME):
            assert raw not in row.redacted_payload
        after = json.loads(row.redacted_payload)
        assert after.keys() == document.keys()
        assert "PRIVATE_EMAIL_" in row.redacted_payload
    arguments = json.loads(row.redacted_payload)["messages"][0]["tool_calls"][0]["function"]["arguments"]
    assert arguments.startswith('{"email":"[PRIVATE_EMAIL_') and arguments.endswith('"n":1.0,"s":"a  b"}')


def test_blocked_broken_and_plain_requests(spark, policy):
    rows = run(
        spark,
        policy,
        chat("Use sk-abc1234567890SECRET"),
        chat("Summarize public docs"),
        {"messages": [{"arguments": '{"q":"see \\"https://x.com\\" now"}'}]},
        "{broken",
        "[1, 2]",
        None,
        {"messages": [{"content": [EMAIL, {"text": "fine"}]}]},
    )
    assert not rows[0].allowed and rows[0].redacted_payload is None and rows[0].blocked_categories == ["api_key"]
    assert rows[1].allowed and json.loads(rows[1].redacted_payload) == chat("Summarize public docs") and rows[1].audit == []
    assert [r.problem for r in rows[2:6]] == ["rewrite_failed", "malformed", "malformed", "malformed"]
    assert not any(r.allowed for r in rows[2:6])
    # Strings directly inside arrays are not text fields.
    assert EMAIL in rows[6].redacted_payload
    kept = quarantine(redact_requests(payloads(spark, chat("Use sk-abc1234567890SECRET")), policy, "k"))
    assert kept.columns == ["request_id", "blocked_categories", "problem"]


def test_payloads_of_any_depth(spark, policy):
    def nested(depth, leaf):
        for i in range(depth):
            leaf = {"content": leaf} if i % 3 else [leaf, {"metadata": ["no"]}]
        return {"messages": [leaf]}

    documents = [nested(d, leaf) for d in (8, 9, 10, 11, 12, 13, 30, 200) for leaf in ({"text": EMAIL}, {"x": EMAIL})]
    rows = run(spark, policy, *documents)
    for i, (row, document) in enumerate(zip(rows, documents)):
        assert row.allowed and (EMAIL in row.redacted_payload) == (i % 2 == 1), i
        token = row.redacted_payload.split('"text":"')[1].split('"')[0] if i % 2 == 0 else EMAIL
        assert json.loads(row.redacted_payload.replace(token, EMAIL)) == document


def test_context_reaches_below_the_native_depth(spark):
    document = {"metadata": [[{"a": {"b": [{"c": "yes"}]}}]], "z": {"y": [{"mcp": {"x": "yes", "l": ["no"]}}]}, "n": {"m": {"k": "no"}}}
    for depth in (1, 2, 3, 4, 5, 12):
        items = extract_items(parse_payloads(payloads(spark, document)), depth=depth)
        got = {r.p: r.text for r in items.select(path_text(F.col("path")).alias("p"), "text").collect()}
        assert got == {"metadata[0][0].a.b[0].c": "yes", "z.y[0].mcp.x": "yes"}, depth


def test_extraction_rules(spark):
    document = {
        "name": "no", "content": "yes", "metadata": {"any": "yes", "deep": {"er": ["no", {"k": "yes"}]}},
        "input": "[1]", "text": "[1]", "annotations": [{"x": "yes"}], "n": 1, "b": None, "summary": "", "result": "{bad",
    }
    items = extract_items(parse_payloads(payloads(spark, document)))
    got = {r.p: (r.text, r.json_encoded) for r in items.withColumn("p", path_text(F.col("path"))).collect()}
    assert got == {
        "content": ("yes", False), "metadata.any": ("yes", False), "metadata.deep.er[1].k": ("yes", False),
        "input": ("[1]", True), "text": ("[1]", False), "annotations[0].x": ("yes", False), "summary": ("", False),
        "result": ("{bad", False),
    }
    more = extract_items(parse_payloads(payloads(spark, document)), array_strings=True)
    assert more.count() == len(got) + 1


def test_conversation_key(spark):
    documents = [
        {"conversation_id": "", "thread_id": "t"}, {"conversation_id": 5, "metadata": {"session_id": "s"}}, {"request_id": "r"}, {},
        {"metadata": "text"},
    ]
    parsed = parse_payloads(payloads(spark, *documents)).orderBy("request_id")
    got = [r.c for r in parsed.select(conversation_key(F.col("_json"), F.col("request_id")).alias("c")).collect()]
    assert got == ["t", "s", "r", "request:3", "request:4"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_request_stays_on_its_row(spark, policy):
    df = payloads(spark, chat(EMAIL))
    plan = plan_of(redact_requests(df, policy, "k"))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    native = policy.copy() if hasattr(policy, "copy") else __import__("copy").deepcopy(policy)
    native.detectors.normalization = False
    assert "Python" not in plan_of(redact_requests(df, native, "k"))
    assert "Python" not in plan_of(df.select(override_model_in_payload(F.col("payload"), "m").alias("p")))


def test_what_is_not_changed_keeps_its_spelling(spark, policy):
    text = '{ "b" : 1.50, "a" :1e5,\n"content" : "mail %s \\u00e9\\n\\"x\\"" , "z":[ ],"o":{ },"n":-0.0, "t":true,"u":null}' % EMAIL
    row = run(spark, policy, text)[0]
    token = row.redacted_payload.split("mail ")[1].split(" ")[0]
    want = '{"b":1.50,"a":1e5,"content":"mail ' + token + ' é\\n\\"x\\"","z":[],"o":{},"n":-0.0,"t":true,"u":null}'
    assert row.redacted_payload == want
    plain = '{ "a" : 1.0 , "content":"nothing here" }'
    assert run(spark, policy, plain)[0].redacted_payload == plain
    keys = '{"content": {"text": "x"}, "te\\u0078t": "%s", "\\"odd": {"metadata": ["%s", {"k": "%s"}]}}' % (EMAIL, EMAIL, EMAIL)
    assert run(spark, policy, keys)[0].redacted_payload.count(EMAIL) == 1


def test_the_walk_in_a_row_finds_what_the_walk_over_rows_finds(spark):
    import random

    from textguard.operators.extract import items_of
    from textguard.operators.jsontext import tokens

    draw = random.Random(2)
    names = ["content", "text", "x", "metadata", "mcp", "arguments", "a\"b", "é", "input", ""]

    def value(depth):
        kind = draw.random()
        if depth and kind < 0.35:
            return {k: value(depth - 1) for k in draw.sample(names, draw.randint(0, 4))}
        if depth and kind < 0.55:
            return [value(depth - 1) for _ in range(draw.randint(0, 3))]
        return draw.choice(["plain", "", "[1]", '{"a": 1}', "{bad", 'q"\\ \n', 1.5, None, True, "é😀"])

    documents = [{k: value(5) for k in draw.sample(names, 4)} for _ in range(150)]
    df = parse_payloads(payloads(spark, *[json.dumps(d, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])) for d in documents]))
    for strings in (False, True):
        rows = df.select("request_id", F.inline(items_of(tokens(F.col("payload")), strings)))
        got = sorted((r.request_id, str(r.path), r.text, r.json_encoded) for r in rows.collect())
        want = sorted((r.request_id, str(r.path), r.text, r.json_encoded) for r in extract_items(df, array_strings=strings).collect())
        assert got == want


def test_model_override(spark):
    df = payloads(spark, {"model": "a", "x": 1}, {"x": {"model": "a"}})
    got = [r.p for r in df.select(override_model_in_payload(F.col("payload"), "b").alias("p")).collect()]
    assert json.loads(got[0]) == {"model": "b", "x": 1} and json.loads(got[1]) == {"x": {"model": "a"}}
    assert df.select(override_model_in_payload(F.col("payload"), None).alias("p")).first().p == json.dumps({"model": "a", "x": 1})
    odd = ['{ "x":{"model":"a"}, "model" : {"a":[1,{"model":2}]} , "y":1.0}', '{"y":"model","model":null}', '{"mod\\u0065l":"a"}', '{"model":"a, } b"}', "[1"]
    got = [r.p for r in payloads(spark, *odd).select(override_model_in_payload(F.col("payload"), 'b"').alias("p")).collect()]
    assert got[0] == '{ "x":{"model":"a"}, "model" :"b\\"", "y":1.0}' and json.loads(got[3]) == {"model": 'b"'} and got[4] == "[1"
    assert json.loads(got[1]) == {"y": "model", "model": 'b"'} and json.loads(got[2]) == {"model": 'b"'}
    columns = spark.createDataFrame([("a",), (None,)], "model string")
    assert [r.model for r in override_model(columns, "b").collect()] == ["b", None]
    assert override_model(columns, "").first().model == "a"


def test_compact_json(spark):
    df = spark.createDataFrame([('{ "a b" : [1.0,\n 2] , "c\\"  d" : "x  y" }',)], "t string")
    assert df.select(compact_json(F.col("t")).alias("t")).first().t == '{"a b":[1.0,2],"c\\"  d":"x  y"}'


def test_replay_and_egress_checks(spark, policy):
    requests = payloads(spark, chat(f"Contact {EMAIL} from 10.1.2.3 about {CODENAME}."), chat("Use sk-abc1234567890SECRET"))
    done = redact_requests(requests, policy, "k")
    body = F.concat(F.coalesce("redacted_payload", F.lit("")), F.to_json("audit"), F.array_join("blocked_categories", ","))
    results = done.select("request_id", "allowed", body.alias("body"))
    shape = "request_id int, expect_allowed boolean, must_contain array<string>, must_not_contain array<string>"
    good = [(0, True, ["PRIVATE_EMAIL", "IP_ADDRESS", "CODENAME"], [EMAIL, "10.1.2.3", CODENAME]), (1, False, ["api_key"], ["SECRET"])]
    assert replay_failures(results, spark.createDataFrame(good, shape), "request_id").collect() == []
    bad = [(0, False, ["NOT_THERE"], ["PRIVATE_EMAIL"]), (9, True, [], [])]
    found = replay_failures(results, spark.createDataFrame(bad, shape), "request_id").collect()
    assert sorted((r.request_id, r.problem) for r in found) == [
        (0, "decision"), (0, "forbidden text"), (0, "missing text"), (9, "decision"),
    ]
    blocked = done.where(~F.col("allowed"))
    assert escaped_requests(blocked, done.where("allowed"), "request_id").collect() == []
    assert escaped_requests(blocked, done, "request_id").count() == 1


def test_leaks_report_names_only(spark, monkeypatch):
    bodies = spark.createDataFrame(
        [(0, '{"body":"owner-demo@example.com"}'), (1, "nothing"), (2, "xProject Ravens"), (3, "a 10.77.1.80 b"), (4, "$$ ##")],
        "id int, body string",
    )
    needles = spark.createDataFrame(
        [("EMAIL", "owner-demo@example.com"), ("CODE", "Project Raven"), ("IP", "10.77.1.8"), ("EMPTY", ""), ("NULL", None),
         ("SIGN", "$ #"), ("PART", "xample.c"), ("LONG", "demo@example.com\"}"), ("ONE", "{"), ("NOT", "zz")],
        "name string, value string",
    )
    found = leaks(bodies, needles, "id")
    assert sorted(tuple(r) for r in found.collect()) == [
        (0, "EMAIL"), (0, "LONG"), (0, "ONE"), (0, "PART"), (2, "CODE"), (3, "IP"), (4, "SIGN"),
    ]
    assert found.columns == ["id", "name"]
    monkeypatch.setattr("textguard.operators.checks.BROADCAST_CHARS", 0)
    assert sorted(leaks(bodies, needles, "id").collect()) == sorted(found.collect())


def test_tokens_are_replaced_in_place(spark):
    from textguard.operators.jsontext import string_leaves, tokens, with_tokens

    text = '{ "a" : ["x", 1, {"b": "y\\\\n"}, [], ""], "c":null, "d" : "z" }'
    df = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("p"))
    places = {leaf.text: leaf.at for leaf in df.select(F.inline(string_leaves(F.col("p")))).collect()}
    assert list(places) == ["x", "y\\n", "", "z"] and list(places.values()) == sorted(places.values())

    def spelled(**new):
        changes = F.create_map(*[F.lit(v) for k, n in new.items() for v in (places[k or ""], n)]) if new else F.expr("CAST(map() AS MAP<INT, STRING>)")
        return df.select(with_tokens(F.col("p"), changes)).first()[0]

    assert spelled() == '{"a":["x",1,{"b":"y\\\\n"},[],""],"c":null,"d":"z"}'
    assert spelled(z='"2"', x='"1"') == '{"a":["1",1,{"b":"y\\\\n"},[],""],"c":null,"d":"2"}'
    # Each change is made once, whatever the number of tokens.
    made = F.transform(F.array(F.lit(places["x"])), lambda at: F.struct(at, F.lit('"new"')))
    plan = df.select(with_tokens(F.col("p"), F.map_from_entries(made)).alias("v"))
    assert plan.first()[0].startswith('{"a":["new",1')
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("transform(array(array_sort(map_entries(") >= 0
