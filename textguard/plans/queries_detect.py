"""Detector, resolution and rewriting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions.regex import java_pattern, match_spans
from textguard.operators.detect import detect, pattern_findings, rule_findings
from textguard.operators.normalize import fold_text, normalize_text, normalized_findings, unleet_text
from textguard.operators.reports import explode_findings, finding_counts
from textguard.operators.resolve import resolve
from textguard.patterns import BY_NAME, SECRETS
from textguard.plans.catalog import (
    DEMO_KEY,
    DOCUMENTS_SQL,
    PAGES_SQL,
    SEEDED_SQL,
    documents,
    findings_sql,
    mask_policy,
    pages,
    pattern_sql,
    query,
    redacted_ctes,
    regex_policy,
    resolved_ctes,
    seeded_turns,
    spans_sql,
    table,
)
from textguard.plans.redact import redact_texts
from textguard.policy import Policy
from textguard.sources.readers import spread

_SPAN = 'id, start, "end", value'


def _one_detector(name: str, source, source_sql: str) -> None:
    pattern = BY_NAME[name]

    @query(f"detect_{name}", f"SELECT {_SPAN} FROM ({pattern_sql(source_sql, pattern)}) AS q")
    def run(spark, folder):
        found = pattern_findings("text", pattern)
        return source(spark, folder).select("id", F.inline(found)).select("id", "start", "end", "value")


_one_detector("email", documents, DOCUMENTS_SQL)
_one_detector("phone", documents, DOCUMENTS_SQL)
_one_detector("ipv4", documents, DOCUMENTS_SQL)
_one_detector("ipv6", seeded_turns, SEEDED_SQL)
_one_detector("url", pages, PAGES_SQL)
_one_detector("internal_domain", pages, PAGES_SQL)
_one_detector("file_path", seeded_turns, SEEDED_SQL)
_one_detector("bare_domain", pages, PAGES_SQL)

_KEYWORD_RULE, _REGEX_RULE = Policy.builtin().rules


@query(
    "detect_keyword",
    " UNION ALL ".join(f"SELECT {_SPAN} FROM ({spans_sql(SEEDED_SQL, v)}) AS q" for v in _KEYWORD_RULE["values"]),
)
def detect_keyword(spark, folder):
    found = rule_findings("text", _KEYWORD_RULE)
    return seeded_turns(spark, folder).select("id", F.inline(found)).select("id", "start", "end", "value")


@query("detect_custom_regex", f"SELECT {_SPAN} FROM ({spans_sql(SEEDED_SQL, _REGEX_RULE['pattern'])}) AS q")
def detect_custom_regex(spark, folder):
    found = rule_findings("text", _REGEX_RULE)
    return seeded_turns(spark, folder).select("id", F.inline(found)).select("id", "start", "end", "value")


def _secrets_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {_SPAN}, '{p.category}' AS category FROM ({pattern_sql(source, p)}) AS q" for p in SECRETS
    )


def _secrets(df):
    found = pattern_findings("text", *SECRETS)
    return df.select("id", F.inline(found)).select("id", "start", "end", "value", "category")


@query("detect_secrets_documents", _secrets_sql(DOCUMENTS_SQL))
def detect_secrets_documents(spark, folder):
    return _secrets(documents(spark, folder))


@query("detect_secrets_turns", _secrets_sql(SEEDED_SQL))
def detect_secrets_turns(spark, folder):
    return _secrets(seeded_turns(spark, folder))


_PAGES_FOUND = findings_sql(PAGES_SQL, regex_policy())


@query(
    "detect_all_pages",
    f'SELECT id, start, "end", value, category, detector, severity FROM ({_PAGES_FOUND}) AS q',
)
def detect_all_pages(spark, folder):
    found = detect(pages(spark, folder), regex_policy())
    return found.select("id", F.inline("findings")).select(
        "id", "start", "end", "value", "category", "detector", "severity"
    )


@query(
    "findings_by_category",
    f"SELECT category, severity, count(*) AS n_findings FROM ({_PAGES_FOUND}) AS q GROUP BY category, severity",
)
def findings_by_category(spark, folder):
    found = detect(pages(spark, folder), regex_policy())
    return finding_counts(explode_findings(found, ["id"], "findings"), ["category", "severity"])


@query(
    "findings_rollup",
    f"""SELECT detector, category, severity, count(*) AS n_findings FROM (
        {findings_sql(SEEDED_SQL, regex_policy(secrets=True, rules=True))}) AS q
        GROUP BY ROLLUP (detector, category, severity)""",
)
def findings_rollup(spark, folder):
    found = detect(seeded_turns(spark, folder), regex_policy(secrets=True, rules=True))
    return finding_counts(
        explode_findings(found, ["id"], "findings"), ["detector", "category", "severity"], totals=True
    )


def _resolved(df, policy):
    kept = resolve(detect(df, policy), policy).select("id", F.inline("resolved"))
    return kept.select("id", "start", "end", "value", "category", "severity", "detector", "rule_id")


_KEPT = f"SELECT {_SPAN}, category, severity, detector, rule_id FROM kept"


@query("resolve_overlaps_pages", f"WITH RECURSIVE {resolved_ctes(PAGES_SQL, regex_policy())} {_KEPT}")
def resolve_overlaps_pages(spark, folder):
    return _resolved(pages(spark, folder), regex_policy())


_FULL = regex_policy(secrets=True, rules=True)


@query("resolve_overlaps_turns", f"WITH RECURSIVE {resolved_ctes(SEEDED_SQL, _FULL)} {_KEPT}")
def resolve_overlaps_turns(spark, folder):
    return _resolved(seeded_turns(spark, folder), _FULL)


_ALLOW = ["example.com", "10.1.2."]


@query(
    "allowlist_filter",
    f"""SELECT id, category, count(*) AS n_findings FROM ({findings_sql(SEEDED_SQL, _FULL)}) AS q
        WHERE NOT contains(value, 'example.com') AND NOT contains(value, '10.1.2.') GROUP BY id, category""",
)
def allowlist_filter(spark, folder):
    from textguard.operators.resolve import drop_allowed

    found = detect(seeded_turns(spark, folder), _FULL)
    left = found.select("id", F.inline(drop_allowed(F.col("findings"), _ALLOW)))
    return left.groupBy("id", "category").agg(F.count(F.lit(1)).alias("n_findings"))


_FLAGSHIP = mask_policy(secrets=True)


@query(
    "mask_documents",
    f"WITH RECURSIVE {redacted_ctes(DOCUMENTS_SQL, _FLAGSHIP)} SELECT id, redacted, n_findings FROM redacted",
)
def mask_documents(spark, folder):
    done = redact_texts(documents(spark, folder), _FLAGSHIP, F.col("id").cast("string"), DEMO_KEY)
    return done.select("id", "redacted", F.size("resolved").cast("bigint").alias("n_findings"))


@query(
    "mask_pages",
    f"WITH RECURSIVE {redacted_ctes(PAGES_SQL, mask_policy())} SELECT id, redacted, n_findings FROM redacted",
)
def mask_pages(spark, folder):
    done = redact_texts(pages(spark, folder), mask_policy(), F.col("id").cast("string"), DEMO_KEY)
    return done.select("id", "redacted", F.size("resolved").cast("bigint").alias("n_findings"))


@query(
    "tokenize_documents",
    f"WITH RECURSIVE {redacted_ctes(DOCUMENTS_SQL, _FULL)} SELECT id, allowed, redacted, n_findings, blocked FROM redacted",
)
def tokenize_documents(spark, folder):
    done = redact_texts(documents(spark, folder), _FULL, F.col("id").cast("string"), DEMO_KEY)
    return done.select(
        "id",
        "allowed",
        "redacted",
        F.size("resolved").cast("bigint").alias("n_findings"),
        F.array_join("blocked_categories", ",").alias("blocked"),
    )


@query("redact_documents")
def redact_documents(spark, folder):
    """The whole default policy, obfuscation included."""
    done = redact_texts(documents(spark, folder), Policy.builtin(), F.col("id").cast("string"), DEMO_KEY)
    return done.select(
        "id",
        "allowed",
        "redacted",
        F.size("resolved").alias("n_findings"),
        F.array_join("blocked_categories", ",").alias("blocked"),
    )


@query("normalize_findings")
def normalize_findings(spark, folder):
    found = seeded_turns(spark, folder).select("id", F.inline(normalized_findings("text")))
    return found.select("id", "start", "end", "category", "severity", "safe_replace")


@query("normalize_findings_documents")
def normalize_findings_documents(spark, folder):
    found = documents(spark, folder).select("id", F.inline(normalized_findings("text")))
    return found.select("id", "start", "end", "category", "severity", "safe_replace")


@query(
    "obfuscated_text",
    """SELECT conv_id * 1000 + turn AS id, length(replace(text, '.', '')) + 1 AS "end" FROM conversations""",
)
def obfuscated_text(spark, folder):
    """Zero-width characters without any finding: the whole text is suspect. Turns hold no sensitive value by themselves; each
    gets a zero-width character and loses its full stops, as sentences that run together look like domains."""
    bare = F.replace("text", F.lit("."), F.lit(""))
    turns = spread(table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id")
    found = turns.select("id", F.concat(bare, F.lit("\u200b")).alias("text")).select("id", F.inline(normalized_findings("text")))
    return found.where("category = 'obfuscated_text'").select("id", F.col("end").cast("bigint").alias("end"))


_FOLD_SQL = r"""SELECT id, translate(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    replace(replace(replace(replace(translate(text, chr(65312) || chr(65294) || chr(12290) || chr(1072) || chr(1077) || chr(1086) || chr(160), '@..aeo '),
      chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), ''),
    '\bat\b', '@', 'gi'), '\bdot\b', '.', 'gi'), '\s*@\s*', '@', 'g'), '\s*\.\s*', '.', 'g'),
  '013457', 'oieast') AS folded FROM ({source}) AS s"""


@query("normalize_text_documents", _FOLD_SQL.replace("{source}", DOCUMENTS_SQL))
def normalize_text_documents(spark, folder):
    return documents(spark, folder).select("id", unleet_text(fold_text(F.col("text"))).alias("folded"))


@query("normalize_text_turns", _FOLD_SQL.replace("{source}", SEEDED_SQL))
def normalize_text_turns(spark, folder):
    return seeded_turns(spark, folder).select("id", unleet_text(fold_text(F.col("text"))).alias("folded"))


@query("normalize_text_full")
def normalize_text_full(spark, folder):
    return normalize_text(documents(spark, folder)).select("id", F.col("normalized").alias("folded"))


@query("obfuscation_reach")
def obfuscation_reach(spark, folder):
    """How many ordinary texts the obfuscation detector would block or rewrite."""
    policy = Policy.builtin()
    found = documents(spark, folder).select("id", normalized_findings("text").alias("f"))
    unsafe = F.exists("f", lambda f: ~f["safe_replace"])
    return found.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.size("f") > 0).alias("n_with_findings"),
        F.count_if(unsafe).alias("n_unsafe"),
        F.count_if(F.exists("f", lambda f: policy.action_column(f["category"]) == "block")).alias("n_blocking"),
    )


@query(
    "clock_times_as_addresses",
    f"SELECT count(*) AS n_matches FROM ({spans_sql(DOCUMENTS_SQL, r'\b(?:[0-9]{1,2}:){2}[0-9]{1,2}\b')}) AS q",
)
def clock_times_as_addresses(spark, folder):
    """Times of day have the shape of short IPv6 addresses; this counts them."""
    spans = match_spans("text", java_pattern(r"\b(?:[0-9]{1,2}:){2}[0-9]{1,2}\b"))
    return documents(spark, folder).select(F.size(spans).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_matches")
    )
