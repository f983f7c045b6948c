"""JSON request payloads built from conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.operators.extract import (
    compact_json,
    conversation_key,
    extract_items,
    override_model_in_payload,
    parse_payloads,
    path_text,
)
from textguard.plans.catalog import (
    DEMO_KEY,
    SEEDED_SQL,
    mask_policy,
    query,
    redacted_ctes,
    regex_policy,
    seeded_turns,
    table,
)
from textguard.plans.redact import quarantine, redact_requests
from textguard.policy import Policy
from textguard.sources.readers import hits_from_json, mask_headers

_FULL = regex_policy(secrets=True, rules=True)
_MASK = mask_policy(secrets=True, rules=True)


def chat_payloads(spark, folder):
    """One request per turn. The conversation id sits at the top, in ``metadata``, or nowhere."""
    place = F.col("turn") % 3
    conversation = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    payload = F.struct(
        F.when(F.col("turn") != 4, F.lit("mock")).alias("model"),
        F.when(place == 0, conversation).alias("conversation_id"),
        F.when(place == 1, F.struct(conversation.alias("thread_id"))).alias("metadata"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"),
    )
    return seeded_turns(spark, folder).select(F.col("id").alias("request_id"), F.to_json(payload).alias("payload"))


_CHAT_JSON = """'{' || CASE WHEN turn <> 4 THEN '"model":"MODEL",' ELSE '' END
  || CASE turn % 3 WHEN 0 THEN '"conversation_id":"c' || CAST(conv_id AS VARCHAR) || '",'
                   WHEN 1 THEN '"metadata":{"thread_id":"c' || CAST(conv_id AS VARCHAR) || '"},' ELSE '' END
  || '"messages":[{"role":' || CAST(to_json(role) AS VARCHAR) || ',"content":' || CAST(to_json(CONTENT) AS VARCHAR) || '}]}'"""


def _chat_json(content: str, model: str = "mock") -> str:
    return _CHAT_JSON.replace("MODEL", model).replace("CONTENT", content)


@query(
    "payload_extract",
    f"""SELECT id AS request_id, 'messages[0].content' AS path, text, false AS json_encoded FROM ({SEEDED_SQL}) AS s
        UNION ALL SELECT id, 'metadata.thread_id', 'c' || CAST(conv_id AS VARCHAR), false FROM ({SEEDED_SQL}) AS s WHERE turn % 3 = 1""",
)
def payload_extract(spark, folder):
    items = extract_items(parse_payloads(chat_payloads(spark, folder)))
    return items.select("request_id", path_text(F.col("path")).alias("path"), "text", "json_encoded")


def nested_payloads(spark, folder):
    """Content blocks, tool calls with JSON in a string, and a tool result below a context key."""
    text = F.col("text")
    arguments = F.to_json(F.struct(text.alias("q"), F.col("turn").alias("n")))
    blocks = F.array(*[F.struct(F.lit("text").alias("type"), t.alias("text")) for t in (text, F.col("role"))])
    call = F.struct(F.struct(F.lit("lookup").alias("name"), arguments.alias("arguments")).alias("function"))
    payload = F.struct(
        F.lit("mock").alias("model"),
        F.array(F.struct("role", blocks.alias("content"))).alias("messages"),
        F.array(call).alias("tool_calls"),
        F.struct(F.struct(F.struct(F.col("role").alias("note"), F.array(text).alias("skipped")).alias("a")).alias("tool_result")).alias("mcp"),
        F.lit(1.5).alias("temperature"),
    )
    return seeded_turns(spark, folder).select(F.col("id").alias("request_id"), F.to_json(payload).alias("payload"))


_ARGUMENTS_SQL = """'{"q":' || CAST(to_json(text) AS VARCHAR) || ',"n":' || CAST(turn AS VARCHAR) || '}'"""


@query(
    "payload_extract_nested",
    f"""WITH s AS ({SEEDED_SQL})
        SELECT id AS request_id, 'messages[0].content[0].text' AS path, text, false AS json_encoded FROM s
        UNION ALL SELECT id, 'messages[0].content[1].text', role, false FROM s
        UNION ALL SELECT id, 'tool_calls[0].function.arguments', {_ARGUMENTS_SQL}, true FROM s
        UNION ALL SELECT id, 'mcp.tool_result.a.note', role, false FROM s""",
)
def payload_extract_nested(spark, folder):
    items = extract_items(parse_payloads(nested_payloads(spark, folder)))
    return items.select("request_id", path_text(F.col("path")).alias("path"), "text", "json_encoded")


@query(
    "payload_extract_array_strings",
    f"""SELECT id AS request_id, count(*) * 5 AS n_items FROM ({SEEDED_SQL}) AS s GROUP BY id""",
)
def payload_extract_array_strings(spark, folder):
    items = extract_items(parse_payloads(nested_payloads(spark, folder)), array_strings=True)
    return items.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_items"))


@query(
    "payload_conversation_key",
    f"""SELECT id AS request_id, CASE WHEN turn % 3 = 2 THEN 'request:' || CAST(id AS VARCHAR)
          ELSE 'c' || CAST(conv_id AS VARCHAR) END AS conversation FROM ({SEEDED_SQL}) AS s""",
)
def payload_conversation_key(spark, folder):
    parsed = parse_payloads(chat_payloads(spark, folder))
    return parsed.select("request_id", conversation_key(F.col("_json"), F.col("request_id")).alias("conversation"))


def _plain(requests):
    return requests.select(
        "request_id",
        "allowed",
        "redacted_payload",
        F.array_join("blocked_categories", ",").alias("blocked"),
        F.col("n_findings").cast("bigint").alias("n_findings"),
        "problem",
    )


@query(
    "payload_rewrite",
    f"""WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _MASK)} SELECT id AS request_id, true AS allowed,
          {_chat_json("redacted")} AS redacted_payload, '' AS blocked, n_findings, CAST(NULL AS VARCHAR) AS problem FROM redacted""",
)
def payload_rewrite(spark, folder):
    return _plain(redact_requests(chat_payloads(spark, folder), _MASK, DEMO_KEY))


_CONVERSATION_SQL = (
    "CASE WHEN turn % 3 = 2 THEN 'request:' || CAST(id AS VARCHAR) ELSE 'c' || CAST(conv_id AS VARCHAR) END"
)


@query(
    "payload_redact",
    f"""WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _FULL, _CONVERSATION_SQL)} SELECT id AS request_id, allowed,
          CASE WHEN allowed THEN {_chat_json("redacted")} END AS redacted_payload, blocked, n_findings,
          CAST(NULL AS VARCHAR) AS problem FROM redacted""",
)
def payload_redact(spark, folder):
    return _plain(redact_requests(chat_payloads(spark, folder), _FULL, DEMO_KEY))


@query("payload_redact_nested")
def payload_redact_nested(spark, folder):
    return _plain(redact_requests(nested_payloads(spark, folder), Policy.builtin(), DEMO_KEY))


# The two texts of a nested payload that may hold something: the first content block, and JSON in a string.
_NESTED_SQL = f"""SELECT id * 10 AS id, role, turn, text FROM ({SEEDED_SQL}) AS s
  UNION ALL SELECT id * 10 + 1, role, turn, {_ARGUMENTS_SQL} FROM ({SEEDED_SQL}) AS s"""
_TEXT_OF = "CAST(to_json(max(redacted) FILTER (id % 10 = {})) AS VARCHAR)"
_NESTED_JSON = f"""'{{"model":"mock","messages":[{{"role":' || CAST(to_json(any_value(role)) AS VARCHAR) || ',"content":[{{"type":"text","text":'
  || {_TEXT_OF.format(0)} || '}},{{"type":"text","text":' || CAST(to_json(any_value(role)) AS VARCHAR)
  || '}}]}}],"tool_calls":[{{"function":{{"name":"lookup","arguments":' || {_TEXT_OF.format(1)}
  || '}}}}],"mcp":{{"tool_result":{{"a":{{"note":' || CAST(to_json(any_value(role)) AS VARCHAR) || ',"skipped":['
  || CAST(to_json(any_value(text) FILTER (id % 10 = 0)) AS VARCHAR) || ']}}}}}},"temperature":1.5}}'"""


@query(
    "payload_redact_blocks",
    f"""WITH RECURSIVE {redacted_ctes(_NESTED_SQL, _FULL, "'request:' || CAST(id // 10 AS VARCHAR)")}
        SELECT id // 10 AS request_id, bool_and(allowed) AS allowed, CASE WHEN bool_and(allowed) THEN {_NESTED_JSON} END AS redacted_payload,
          array_to_string(list_sort(list_distinct(flatten(list(string_split(blocked, ',')) FILTER (blocked <> '')))), ',') AS blocked,
          CAST(sum(n_findings) AS BIGINT) AS n_findings, CAST(NULL AS VARCHAR) AS problem FROM redacted GROUP BY id // 10""",
)
def payload_redact_blocks(spark, folder):
    """Content blocks, JSON in strings and context keys, with the detectors that SQL can repeat."""
    done = _plain(redact_requests(nested_payloads(spark, folder), _FULL, DEMO_KEY))
    return done.withColumn("blocked", F.nullif("blocked", F.lit("")))


@query(
    "payload_quarantine",
    f"""WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _FULL, _CONVERSATION_SQL)}
        SELECT id AS request_id, CASE WHEN turn = 5 THEN '' ELSE blocked END AS blocked,
               CASE WHEN turn = 5 THEN 'malformed' END AS problem FROM redacted WHERE NOT allowed OR turn = 5""",
)
def payload_quarantine(spark, folder):
    """Every sixth turn's payload is cut short, hence not JSON."""
    whole = chat_payloads(spark, folder)
    cut = F.when(F.col("request_id") % 1000 == 5, F.expr("substr(payload, 1, length(payload) - 3)")).otherwise(F.col("payload"))
    blocked = quarantine(redact_requests(whole.withColumn("payload", cut), _FULL, DEMO_KEY))
    return blocked.select("request_id", F.array_join("blocked_categories", ",").alias("blocked"), "problem")


@query(
    "model_override",
    f"SELECT id AS request_id, {_chat_json('text', 'other-model')} AS payload FROM ({SEEDED_SQL}) AS s",
)
def model_override(spark, folder):
    return chat_payloads(spark, folder).select(
        "request_id", override_model_in_payload(F.col("payload"), "other-model").alias("payload")
    )


@query(
    "json_compact",
    f"SELECT id AS request_id, {_ARGUMENTS_SQL} AS arguments FROM ({SEEDED_SQL}) AS s",
)
def json_compact(spark, folder):
    """Blanks between the parts of a JSON text go; those inside strings stay."""
    loose = F.concat(F.lit('{ "q" :\n '), F.to_json(F.struct("text")), F.lit(""))
    inner = F.regexp_extract(loose, r'(?s)"text":(.*)\}$', 1)
    spaced = F.concat(F.lit('{ "q" :\n '), inner, F.lit(' ,\t"n": '), F.col("turn").cast("string"), F.lit(" }"))
    return seeded_turns(spark, folder).select(F.col("id").alias("request_id"), compact_json(spaced).alias("arguments"))


@query(
    "header_redact",
    """SELECT page_id, 'GET' AS method, url, '[redacted]' AS authorization, '[redacted]' AS api_key, 'text/html' AS accept, 3 AS n_headers
       FROM pages""",
)
def header_redact(spark, folder):
    headers = F.create_map(
        F.lit("Authorization"), F.concat(F.lit("Bearer "), F.col("page_id").cast("string")),
        F.lit("X-Api-Key"), F.col("url"),
        F.lit("accept"), F.lit("text/html"),
    )
    captures = table(spark, folder, "pages").select(
        "page_id", F.lit("GET").alias("method"), "url", headers.alias("headers"), F.col("html").alias("body")
    )
    masked = mask_headers(captures)
    return masked.select(
        "page_id",
        "method",
        "url",
        F.col("headers")["Authorization"].alias("authorization"),
        F.col("headers")["X-Api-Key"].alias("api_key"),
        F.col("headers")["accept"].alias("accept"),
        F.size("headers").alias("n_headers"),
    )


@query(
    "external_hit_feed",
    """SELECT doc_id AS id, 'private_person' AS label, quality AS start, 7 AS "end",
         CASE WHEN toxic = 0 THEN CAST(0.25 AS DOUBLE) END AS score FROM labels
       UNION ALL SELECT doc_id, 'secret', 1, 2, CAST(NULL AS DOUBLE) FROM labels WHERE doc_id % 2 = 0""",
)
def external_hit_feed(spark, folder):
    """Landed detector responses in both shapes."""
    hit = F.struct(
        F.lit("private_person").alias("label"), F.col("quality").alias("start"), F.lit(7).alias("end"),
        F.when(F.col("toxic") == 0, F.lit(0.25)).alias("score"),
    )
    other = F.struct(F.lit("secret").alias("label"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    one = F.to_json(F.array(hit))
    two = F.concat(F.lit('{"findings":['), F.to_json(hit), F.lit(","), F.to_json(other), F.lit("]}"))
    landed = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, two).otherwise(one).alias("response")
    )
    return landed.select("id", F.inline(hits_from_json(F.col("response"))))
