"""Whole pipelines: tables of texts, and tables of JSON requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.arrays import computed_once
from textguard.functions.keyed import with_key
from textguard.operators.act import audit_records, blocked_categories, decide, replacement_column, rewrite, splice
from textguard.operators.detect import detect, findings_of_each
from textguard.operators.extract import (
    EDIT_TYPE,
    compact_json,
    conversation_key,
    extract_items,
    is_json_text,
    items_of,
    parse_payloads,
    write_back,
)
from textguard.operators.jsontext import literal_of, tokens, with_tokens
from textguard.operators.resolve import drop_allowed, resolve, resolve_findings
from textguard.operators.tokens import apply_tokens, number_values, occurrences, scoped_token, token_key
from textguard.operators.vault import with_idle_epoch
from textguard.policy import Policy
from textguard.session import durable

AUDIT_TYPE = (
    "array<struct<category:string,severity:string,detector:string,action:string,audit_only:boolean,"
    "rule_id:string,normalized:boolean,policy_mode:string,policy_hash:string,confidence:double,reason:string>>"
)


def inspect_texts(df: DataFrame, policy: Policy, text: str = "text", hits: str | None = None) -> DataFrame:
    """Detect, resolve and decide: adds ``resolved``, ``blocked_categories`` and ``allowed``."""
    return decide(resolve(detect(df, policy, text, hits), policy), policy).drop("findings")


def redact_texts(
    df: DataFrame,
    policy: Policy,
    conversation: Column,
    key: str | None = None,
    text: str = "text",
    hits: str | None = None,
    epoch: Column | None = None,
) -> DataFrame:
    """Also rewrite (adds ``redacted``) with conversation-scoped tokens. No shuffle: works on batch
    and streaming tables alike. For sequential tokens see ``redact_table``."""
    if policy.tokenization.mode == "deterministic":
        raise ValueError("sequential tokens number a whole table: use redact_table")
    inspected = inspect_texts(with_key(df, key or token_key(df.sparkSession)), policy, text, hits)
    return rewrite(inspected, policy, scoped_token(policy, conversation, epoch), text).drop("_key")


def redact_with_lives(
    df: DataFrame, policy: Policy, conversation: str, ts: str, key: str | None = None, text: str = "text", hits: str | None = None
) -> DataFrame:
    """Redact a batch table of timed texts; tokens change when a conversation was idle for longer than the policy's
    ``tokenization.ttl_seconds``. Adds ``epoch``, the life that each text is in."""
    alive = with_idle_epoch(df, conversation, ts, policy.tokenization.ttl_seconds)
    return redact_texts(alive, policy, F.col(conversation).cast("string"), key, text, hits, F.col("epoch"))


def redact_table(
    df: DataFrame,
    policy: Policy,
    order: list[str],
    conversation: Column,
    key: str | None = None,
    hits: str | None = None,
) -> DataFrame:
    """Redact a batch table in the policy's token mode. ``order`` identifies and orders the texts;
    sequential tokens are numbered over the whole table in that order."""
    if policy.tokenization.mode != "deterministic":
        return redact_texts(df, policy, conversation, key, hits=hits)
    items = durable(inspect_texts(df, policy, hits=hits))
    found = durable(occurrences(items, policy, order, []))
    return apply_tokens(items, found, number_values(found, order), policy, order)


def audit_table(items: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """One row per resolved finding, blocked texts included."""
    return items.select(*keys, F.inline(audit_records(policy, F.col("resolved"))))


def redact_requests(
    requests: DataFrame,
    policy: Policy,
    key: str | None = None,
    request_id: str = "request_id",
    payload: str = "payload",
) -> DataFrame:
    """``(request_id, allowed, redacted_payload, blocked_categories, audit, n_findings, problem)``.

    One blocked text blocks its request. Malformed payloads and JSON strings that redaction would
    break are not let through either (``problem`` says which). A request is one row from the scan to the
    sink: its text fields are an array in the row, so nothing is shuffled, and streams are read in append mode. Only sequential
    tokens, which number the values of a whole table, take the fields out to rows and back.
    """
    if policy.tokenization.mode == "deterministic":
        return _redact_numbered(requests, policy, key, request_id, payload)
    source = with_key(requests.select(request_id, payload), key or token_key(requests.sparkSession))
    parsed = parse_payloads(source, payload).withColumn("conversation", conversation_key(F.col("_json"), F.col(request_id)))
    parts = F.when(~F.col("malformed"), tokens(F.col(payload)))
    walked = parsed.withColumn("_tokens", computed_once(parts)).withColumn("_items", computed_once(items_of(F.col("_tokens"))))
    texts = walked.withColumn("_texts", F.transform("_items", lambda i: i["text"]))
    found = texts.withColumn("_found", computed_once(findings_of_each("_texts", policy)))
    kept = found.withColumn(
        "_kept", computed_once(F.transform("_found", lambda f: resolve_findings(drop_allowed(f, policy.allowlist), policy)))
    )
    token = scoped_token(policy, F.col("conversation"))

    def done(item: Column, resolved: Column) -> Column:
        blocked = blocked_categories(policy, resolved)
        changed = splice(item["text"], resolved, replacement_column(policy, token))
        return F.struct(
            item["at"].alias("at"),
            item["json_encoded"].alias("json_encoded"),
            resolved.alias("resolved"),
            blocked.alias("blocked"),
            F.when(F.size(blocked) == 0, changed).alias("redacted"),
        )

    touched = F.filter(
        F.zip_with("_items", "_kept", lambda i, r: F.struct(i.alias("i"), r.alias("r"))),
        lambda p: (F.size(p["r"]) > 0) | p["i"]["json_encoded"],
    )
    acted = kept.withColumn("_done", computed_once(F.transform(touched, lambda p: done(p["i"], p["r"]))))

    def literal(d: Column) -> Column:
        return literal_of(F.when(d["json_encoded"], compact_json(d["redacted"])).otherwise(d["redacted"]))

    categories = F.array_sort(F.array_distinct(F.flatten(F.transform("_done", lambda d: d["blocked"]))))
    broken = F.exists(
        "_done", lambda d: d["json_encoded"] & (F.size(d["blocked"]) == 0) & ~F.coalesce(is_json_text(d["redacted"]), F.lit(False))
    )
    problem = F.when(F.col("malformed"), "malformed").when(F.col("_broken"), "rewrite_failed")
    none = F.array().cast("array<string>")
    rolled = acted.withColumns(
        {"_broken": computed_once(F.coalesce(broken, F.lit(False))), "blocked_categories": computed_once(F.coalesce(categories, none))}
    ).withColumn("problem", problem)
    rolled = rolled.withColumn("allowed", F.col("problem").isNull() & (F.size("blocked_categories") == 0))
    changes = F.map_from_entries(F.transform("_done", lambda d: F.struct(d["at"], literal(d))))
    # A payload without findings and without JSON in strings stays as it is spelled.
    rewritten = F.when(F.size("_done") > 0, with_tokens(F.col("_tokens"), changes)).otherwise(F.col(payload))
    audit = F.coalesce(
        F.flatten(F.transform("_done", lambda d: audit_records(policy, d["resolved"]))), F.array().cast(AUDIT_TYPE)
    )
    return rolled.select(
        request_id,
        "allowed",
        computed_once(F.when(F.col("allowed"), rewritten)).alias("redacted_payload"),
        "blocked_categories",
        computed_once(audit).alias("audit"),
        F.coalesce(F.aggregate("_done", F.lit(0), lambda n, d: n + F.size(d["resolved"])), F.lit(0)).alias("n_findings"),
        "problem",
    )


def _redact_numbered(requests: DataFrame, policy: Policy, key: str | None, request_id: str, payload: str) -> DataFrame:
    """The same with sequential tokens. Only texts with something to report or change are shuffled back to their
    request. ``request_id`` must be unique."""
    parsed = parse_payloads(requests.select(request_id, payload), payload).withColumn(
        "conversation", conversation_key(F.col("_json"), F.col(request_id))
    )
    keyed = extract_items(parsed.select(F.struct(request_id, "conversation").alias("_k"), "_json", "malformed"), "_k")
    items = redact_table(keyed, policy, ["_k", "path"], F.col("_k.conversation"), key)
    broken = F.col("json_encoded") & F.col("allowed") & ~F.coalesce(is_json_text(F.col("redacted")), F.lit(False))
    touched = (
        items.withColumn("_broken", broken)
        .where((F.size("resolved") > 0) | F.col("json_encoded"))
        .select(
            F.col(f"_k.{request_id}").alias(request_id),
            "path",
            "redacted",
            "json_encoded",
            "allowed",
            "_broken",
            "blocked_categories",
            audit_records(policy, F.col("resolved")).alias("audit"),
        )
    )
    per_request = touched.groupBy(request_id).agg(
        F.bool_and("allowed").alias("_allowed"),
        F.bool_or("_broken").alias("_broken"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocked_categories")))).alias("_categories"),
        F.array_sort(
            # Equal lines of a file share an id and their items, which count once.
            F.collect_set(F.struct("path", "redacted", "json_encoded", "audit"))
        ).alias("_items"),
    )
    joined = parsed.select(request_id, payload, "malformed").join(per_request, request_id, "left")
    problem = (
        F.when(F.col("malformed"), "malformed")
        .when(F.col("_broken"), "rewrite_failed")
    )
    edits = F.transform(
        "_items",
        lambda i: F.struct(i["path"].alias("path"), i["redacted"].alias("text"), i["json_encoded"].alias("json_encoded")),
    ).cast(EDIT_TYPE)
    rewritten = joined.withColumn("problem", problem).withColumn(
        "allowed", F.col("problem").isNull() & F.coalesce("_allowed", F.lit(True))
    )
    needs = F.col("allowed") & F.col("_items").isNotNull()
    # Untouched payloads skip Python: they go through as nulls.
    rewritten = rewritten.withColumn("_needs", needs).withColumn(
        "_new", write_back(F.when(F.col("_needs"), F.col(payload)), F.when(F.col("_needs"), edits))
    )
    failed = F.col("_needs") & F.col("_new").isNull()
    rewritten = rewritten.withColumns(
        {"problem": F.when(failed, "rewrite_failed").otherwise(F.col("problem")), "allowed": F.col("allowed") & ~failed}
    )
    audit = F.coalesce(F.flatten(F.transform("_items", lambda i: i["audit"])), F.array().cast(AUDIT_TYPE))
    return rewritten.select(
        request_id,
        "allowed",
        F.when(F.col("allowed"), F.when(F.col("_needs"), F.col("_new")).otherwise(F.col(payload))).alias("redacted_payload"),
        F.coalesce("_categories", F.array().cast("array<string>")).alias("blocked_categories"),
        audit.alias("audit"),
        F.size(audit).alias("n_findings"),
        "problem",
    )


def quarantine(requests: DataFrame, request_id: str = "request_id") -> DataFrame:
    """What may be kept of blocked requests: which categories or problem, never the text."""
    return requests.where(~F.col("allowed")).select(request_id, "blocked_categories", "problem")
