"""Detectors: text column -> array of findings, as JVM expressions.

Detection never shuffles: each text is one row and every detector is a column expression on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.arrays import computed_once
from textguard.functions.regex import java_keyword, java_pattern, matches_sql, spans_of, sql_name, sql_string
from textguard.operators.normalize import normalized_findings, normalized_findings_of_each
from textguard.patterns import BUILTIN, SECRETS, Pattern
from textguard.policy import Policy

FINDING_TYPE = (
    "struct<category:string,start:int,end:int,value:string,detector:string,severity:string,"
    "rule_id:string,normalized:boolean,safe_replace:boolean,confidence:double>"
)
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"


def finding(
    category: Column,
    start: Column,
    end: Column,
    value: Column,
    detector: Column,
    severity: Column,
    rule_id: Column | None = None,
    normalized: Column | None = None,
    safe_replace: Column | None = None,
    confidence: Column | None = None,
) -> Column:
    return F.struct(
        category.alias("category"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        value.alias("value"),
        detector.alias("detector"),
        severity.alias("severity"),
        (F.lit(None).cast("string") if rule_id is None else rule_id).alias("rule_id"),
        (F.lit(False) if normalized is None else normalized).alias("normalized"),
        (F.lit(True) if safe_replace is None else safe_replace).alias("safe_replace"),
        (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence"),
    )


def no_findings() -> Column:
    return F.array().cast(FINDINGS_TYPE)


def _entry(
    text: str,
    pattern: str,
    category: str,
    detector: str,
    severity: str,
    guard: str | None = None,
    rule_id: str | None = None,
    skip: tuple[str, ...] = (),
    lead: bool = False,
) -> str:
    labels = {
        "category": sql_string(category),
        "detector": sql_string(detector),
        "severity": sql_string(severity),
        "rule_id": "CAST(NULL AS STRING)" if rule_id is None else sql_string(rule_id),
        "skip": f"CAST(array({', '.join(map(sql_string, skip))}) AS ARRAY<STRING>)",
    }
    return matches_sql(text, pattern, guard, labels, lead)


def _pattern_entry(text: str, p: Pattern) -> str:
    spelled = p.anchored.pattern if p.anchored else p.pattern
    return _entry(text, java_pattern(spelled), p.category, p.detector, p.severity, p.guard, None, p.skip_suffixes, bool(p.anchored))


def _rule_entries(text: str, rule: dict) -> list[str]:
    detector = "custom_regex" if rule["type"] == "regex" else "keyword"
    category = rule.get("category", rule["id"])
    severity = rule.get("severity", "medium")
    return [_entry(text, p, category, detector, severity, rule_id=rule["id"]) for p in rule_patterns(rule)]


def rule_patterns(rule: dict) -> list[str]:
    if rule["type"] == "regex":
        return [java_pattern(rule["pattern"])]
    return [java_keyword(value) for value in rule["values"]]


def _hits_to_findings(hits: Column) -> Column:
    """Findings from the hits of several patterns, in the order given. One lambda serves them all."""

    def spans(found: Column) -> Column:
        kept = F.filter(
            spans_of(found),
            # A match without characters cannot be redacted; rules that allow one are refused, and this is the second guard.
            lambda s: (s["end"] > s["start"]) & ~F.exists(found["skip"], lambda suffix: F.endswith(s["value"], suffix)),
        )
        return F.transform(
            kept,
            lambda s: finding(
                found["category"],
                s["start"],
                s["end"],
                s["value"],
                found["detector"],
                found["severity"],
                rule_id=found["rule_id"],
            ),
        )

    return F.flatten(F.transform(hits, spans))


def _entries_to_findings(entries: list[str]) -> Column:
    if not entries:
        return no_findings()
    return _hits_to_findings(F.array_compact(F.expr(f"array({', '.join(entries)})")))


def pattern_findings(text: str, *patterns: Pattern) -> Column:
    """Findings of built-in patterns in a text column."""
    return _entries_to_findings([_pattern_entry(sql_name(text), p) for p in patterns])


def rule_findings(text: str, *rules: dict) -> Column:
    """Findings of custom rules in a text column."""
    return _entries_to_findings([e for r in rules for e in _rule_entries(sql_name(text), r)])


def _native_entries(source: str, policy: Policy) -> list[str]:
    entries: list[str] = []
    if policy.detectors.regex:
        entries += [_pattern_entry(source, p) for p in BUILTIN]
        entries += [e for r in policy.rules for e in _rule_entries(source, r)]
    if policy.detectors.secrets:
        entries += [_pattern_entry(source, p) for p in SECRETS]
    return entries


def native_findings(text: str, policy: Policy) -> Column:
    """All pattern findings in reporting order; switched-off detectors do not enter the plan."""
    return _entries_to_findings(_native_entries(sql_name(text), policy))


def findings_of_each(texts: str, policy: Policy) -> Column:
    """Findings of every text in a column of arrays of texts (without nulls): ``array<array<finding>>``, as ``detect`` gives them."""
    entries = _native_entries("t", policy)
    nothing = F.transform(texts, lambda t: no_findings())
    found = nothing
    if entries:
        hits = F.expr(f"transform(`{texts}`, t -> array_compact(array({', '.join(entries)})))")
        found = F.transform(hits, _hits_to_findings)
    if policy.detectors.normalization:
        found = F.zip_with(found, normalized_findings_of_each(texts), lambda a, b: F.concat(a, b))
    return found


def detect(
    df: DataFrame,
    policy: Policy,
    text: str = "text",
    hits: str | None = None,
    output: str = "findings",
) -> DataFrame:
    """Add ``output``: every finding of every enabled detector, unresolved.

    ``hits`` names an ``array<finding>`` column of outside findings (see ``operators.hits``).
    """
    columns = [native_findings(text, policy)]
    if hits and policy.hits_enabled:
        columns.append(F.coalesce(F.col(hits), no_findings()))
    if policy.detectors.normalization:
        columns.append(normalized_findings(text))
    return df.withColumn(output, computed_once(F.concat(*columns) if len(columns) > 1 else columns[0]))
