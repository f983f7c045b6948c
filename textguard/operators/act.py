"""Decide and rewrite: block, mask, tokenize or keep each resolved finding of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.arrays import bind, computed_once
from textguard.policy import Policy

SPLICE_CHUNK = 64
UNSAFE_REASON = "normalized finding could not be safely mapped to an original span"


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Replace disjoint, ordered spans of a text.

    ``substring`` walks from the start of its input, so cutting every piece out of a long text would
    be quadratic. Spans are taken in chunks: one cut per chunk from the text, the rest from that cut.
    """

    def piece(segment: Column, base: Column, group: Column) -> Column:
        def one(span: Column, i: Column) -> Column:
            done = F.when(i > 0, F.get(group, i - 1)["end"]).otherwise(base)
            gap = F.substr(segment, done - base + 1, span["start"] - done)
            return F.concat(gap, replacement(span))

        return F.array_join(F.transform(group, one), "")

    def chunk(all_spans: Column, index: Column) -> Column:
        first = index * SPLICE_CHUNK
        base = F.when(first > 0, F.get(all_spans, first - 1)["end"]).otherwise(F.lit(0))
        return bind(
            F.struct(F.slice(all_spans, first + 1, SPLICE_CHUNK).alias("group"), base.alias("base")),
            lambda c: bind(
                F.substr(text, c["base"] + 1, F.element_at(c["group"], -1)["end"] - c["base"]),
                lambda segment: piece(segment, c["base"], c["group"]),
            ),
        )

    def whole(all_spans: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_spans) - 1) / SPLICE_CHUNK).cast("int"))
        tail = F.substr(text, F.element_at(all_spans, -1)["end"] + 1)
        return F.concat(F.array_join(F.transform(chunks, lambda c: chunk(all_spans, c)), ""), tail)

    return F.when(F.size(spans) > 0, bind(spans, whole)).otherwise(text)


def blocked_categories(policy: Policy, resolved: Column) -> Column:
    """Categories of the findings that block a text."""

    def blocks(f: Column) -> Column:
        harmful = (policy.action_column(f["category"]) == "block") | ~f["safe_replace"]
        return ~policy.audit_only_column(f["rule_id"]) & harmful

    return F.array_sort(F.array_distinct(F.transform(F.filter(resolved, blocks), lambda f: f["category"])))


def decide(df: DataFrame, policy: Policy, resolved: str = "resolved") -> DataFrame:
    """Add ``blocked_categories`` and ``allowed`` per text."""
    return df.withColumn("blocked_categories", blocked_categories(policy, F.col(resolved))).withColumn(
        "allowed", F.size("blocked_categories") == 0
    )


def replacement_column(policy: Policy, token: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Finding -> the string that takes its place. ``token`` makes placeholders."""

    def build(f: Column) -> Column:
        action = policy.action_column(f["category"])
        return (
            F.when(policy.audit_only_column(f["rule_id"]), f["value"])
            .when(action == "mask", F.concat(F.lit("["), F.upper(f["category"]), F.lit("_REDACTED]")))
            .when(action == "tokenize", token(f))
            .otherwise(f["value"])
        )

    return build


def rewrite(
    df: DataFrame,
    policy: Policy,
    token: Callable[[Column], Column],
    text: str = "text",
    resolved: str = "resolved",
    output: str = "redacted",
) -> DataFrame:
    """Add the rewritten text; null where the text is blocked, so raw text cannot slip through."""
    spliced = splice(F.coalesce(F.col(text), F.lit("")), F.col(resolved), replacement_column(policy, token))
    return df.withColumn(output, computed_once(F.when(F.col("allowed"), spliced)))


def audit_records(policy: Policy, resolved: Column) -> Column:
    """One record per resolved finding, never with the raw value."""
    return F.transform(
        resolved,
        lambda f: F.struct(
            f["category"].alias("category"),
            f["severity"].alias("severity"),
            f["detector"].alias("detector"),
            policy.action_column(f["category"]).alias("action"),
            policy.audit_only_column(f["rule_id"]).alias("audit_only"),
            f["rule_id"].alias("rule_id"),
            f["normalized"].alias("normalized"),
            F.lit(policy.mode).alias("policy_mode"),
            F.lit(policy.fingerprint()).alias("policy_hash"),
            f["confidence"].alias("confidence"),
            F.when(~f["safe_replace"], F.lit(UNSAFE_REASON)).alias("reason"),
        ),
    )
