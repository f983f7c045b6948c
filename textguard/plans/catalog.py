"""Registry of runnable queries, each with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.patterns import BUILTIN, SECRETS, Pattern
from textguard.policy import ACTION_RANK, SEVERITY_RANK, Policy
from textguard.session import ship_package
from textguard.sources.readers import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}

# Checks need the same tokens on both sides, so registered queries use a published demo key.
DEMO_KEY = "demo-key-for-checks"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return run(spark, folder)

        QUERIES[name] = shipped
        if sql is not None:
            CHECK_SQL[name] = sql
        return run

    return register


# -- inputs -------------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


PAGE_TEXT = "url || ' ' || html"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    scan = spread(table(spark, folder, "pages").select("page_id", "url", "html"), "page_id")
    return scan.selectExpr("page_id AS id", f"{PAGE_TEXT} AS text")


# Turns hold no sensitive values, so every turn gets a fragment derived from its ids. Valid in both
# Spark and DuckDB.
_CONV = "CAST(conv_id AS STRING)"
_ZERO_WIDTH = "\u200b"
SEEDED_TEXT = f"""text || CASE (conv_id * 7 + turn) % 8
  WHEN 0 THEN ' Contact user' || {_CONV} || '@example.com from 10.1.2.' || CAST(conv_id % 250 AS STRING) || ' about Project Raven.'
  WHEN 1 THEN ' Call 212-555-' || CAST(1000 + conv_id % 9000 AS STRING) || ' or see https://host' || {_CONV} || '.example.org/p?q=1 on ABC-SEC-' || CAST(100 + conv_id % 900 AS STRING)
  WHEN 2 THEN ' Use OPENAI_API_KEY=sk-abc1234567890SECRET' || {_CONV} || ' here'
  WHEN 3 THEN ' Files in /home/user' || {_CONV} || '/notes.txt on fe80:1:2:3:4:5:6:7 and client orion'
  WHEN 4 THEN ' Reach alice' || {_CONV} || ' at example dot com'
  WHEN 5 THEN ' Reach bob{_ZERO_WIDTH}' || {_CONV} || '@example.com'
  WHEN 6 THEN ' api.internal.corp.example.com and user' || CAST(conv_id % 5 AS STRING) || '@example.com'
  ELSE '' END"""
SEEDED_SQL = f"SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, {SEEDED_TEXT} AS text FROM conversations"


def seeded_turns(spark: SparkSession, folder: str) -> DataFrame:
    scan = table(spark, folder, "conversations").selectExpr("conv_id * 1000 + turn AS id", "*")
    return spread(scan, "id").selectExpr(
        "id", "conv_id", "turn", "role", f"{SEEDED_TEXT} AS text"
    )


DOCUMENTS_SQL = "SELECT doc_id AS id, text FROM documents"
PAGES_SQL = f"SELECT page_id AS id, {PAGE_TEXT} AS text FROM pages"


# -- policies -----------------------------------------------------------------------------------


def regex_policy(secrets: bool = False, rules: bool = False, **actions: str) -> Policy:
    """The default policy with only the detectors that SQL can repeat."""
    policy = Policy.builtin()
    policy.detectors.normalization = False
    policy.detectors.secrets = secrets
    if not rules:
        policy.rules = []
    policy.actions.update(actions)
    return policy


def mask_policy(**kwargs: bool) -> Policy:
    policy = regex_policy(**kwargs)
    policy.actions = {c: "mask" for c in policy.actions}
    return policy


# -- SQL pieces ---------------------------------------------------------------------------------

_PHONE_CORE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def spans_sql(source: str, pattern: str, keep: str = "true") -> str:
    """``id, start, end, value, i`` of all matches of a pattern over ``source (id, text)``."""
    p = quoted(pattern)
    return f"""
      SELECT id, CAST(stop - length(value) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", value, i
      FROM (SELECT id, value, i, sum(length(gap) + length(value)) OVER (PARTITION BY id ORDER BY i) AS stop
            FROM (SELECT id, unnest(v) AS value, unnest(g[1:len(v)]) AS gap, generate_subscripts(v, 1) AS i
                  FROM (SELECT id, regexp_extract_all(text, {p}, 0, 'i') AS v,
                               regexp_split_to_array(text, {p}, 'i') AS g
                        FROM ({source}) AS s WHERE regexp_matches(text, {p}, 'i')) AS m) AS u) AS w
      WHERE {keep}"""


def phone_sql(source: str) -> str:
    """Phones without look-around: match with one more character in front, find the phone in it, and
    keep it if no digit follows."""
    p = quoted(f"(?:^|[^0-9])({_PHONE_CORE})")
    return f"""
      SELECT id, CAST(stop - length(value) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", value, i
      FROM (SELECT id, text, value, i, sum(length(gap) + length(seen)) OVER (PARTITION BY id ORDER BY i) AS stop
            FROM (SELECT id, text, unnest(v) AS seen, unnest(c) AS value, unnest(g[1:len(v)]) AS gap,
                         generate_subscripts(v, 1) AS i
                  FROM (SELECT id, text, regexp_extract_all(text, {p}, 0, 'i') AS v,
                               regexp_extract_all(text, {p}, 1, 'i') AS c,
                               regexp_split_to_array(text, {p}, 'i') AS g
                        FROM ({source}) AS s WHERE regexp_matches(text, {p}, 'i')) AS m) AS u) AS w
      WHERE NOT regexp_matches(substr(text, CAST(stop + 1 AS BIGINT), 1), '[0-9]')"""


def pattern_sql(source: str, pattern: Pattern) -> str:
    if pattern.name == "phone":
        return phone_sql(source)
    keep = " AND ".join(f"NOT ends_with(value, {quoted(s)})" for s in pattern.skip_suffixes) or "true"
    return spans_sql(source, pattern.pattern, keep)


def findings_sql(source: str, policy: Policy) -> str:
    """All findings of the native detectors, with ranks, as one UNION ALL."""
    parts: list[tuple[str, str, str, str, str]] = []
    if policy.detectors.regex:
        parts += [(pattern_sql(source, p), p.category, p.severity, p.detector, "NULL") for p in BUILTIN]
        for rule in policy.rules:
            kind = "custom_regex" if rule["type"] == "regex" else "keyword"
            patterns = [rule["pattern"]] if rule["type"] == "regex" else rule["values"]
            for pattern in patterns:
                parts.append((spans_sql(source, pattern), rule["category"], rule["severity"], kind, quoted(rule["id"])))
    if policy.detectors.secrets:
        parts += [(pattern_sql(source, p), p.category, p.severity, p.detector, "NULL") for p in SECRETS]
    selects = []
    for order, (spans, category, severity, detector, rule_id) in enumerate(parts):
        action = policy.action_for(category)
        selects.append(
            f"""SELECT id, start, "end", value, {quoted(category)} AS category, {quoted(severity)} AS severity,
            {quoted(detector)} AS detector, CAST({rule_id} AS VARCHAR) AS rule_id, {quoted(action)} AS action,
            {ACTION_RANK[action]} AS arank, {SEVERITY_RANK[severity]} AS srank, {order} AS ord, i FROM ({spans}) AS x"""
        )
    return " UNION ALL ".join(selects)


def resolved_ctes(source: str, policy: Policy, more: str = "") -> str:
    """CTEs ending in ``kept``: findings after overlap resolution, swept row by row per text. ``more`` is SQL of findings
    of other detectors."""
    columns = 'start, "end", value, category, severity, detector, rule_id, action, arank, srank'
    mine = ", ".join(f"CASE WHEN apart OR wins THEN o_{c.strip(chr(34))} ELSE r_{c.strip(chr(34))} END" for c in columns.split(", "))
    names = [c.strip('"') for c in columns.split(", ")]
    o_columns = ", ".join(f'o."{c}" AS o_{c}' for c in names)
    r_columns = ", ".join(f'r."{c}" AS r_{c}' for c in names)
    return f"""
    found AS ({findings_sql(source, policy)}{' UNION ALL ' + more if more else ''}),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, start - "end", -arank, -srank, ord, i) AS rn
                FROM found),
    swept(id, rn, seq, {columns}) AS (
      SELECT id, rn, 0, {columns} FROM ordered WHERE rn = 1
      UNION ALL
      SELECT id, rn, seq + CASE WHEN apart THEN 1 ELSE 0 END, {mine}
      FROM (SELECT o.id, o.rn, r.seq, o.start >= r."end" AS apart,
                   (o.arank > r.arank OR (o.arank = r.arank AND (o.srank > r.srank OR (o.srank = r.srank
                     AND o."end" - o.start >= r."end" - r.start)))) AS wins, {o_columns}, {r_columns}
            FROM swept r JOIN ordered o ON o.id = r.id AND o.rn = r.rn + 1) AS step),
    kept AS (SELECT DISTINCT ON (id, seq) id, seq, {columns} FROM swept ORDER BY id, seq, rn DESC)"""


def hmac_sql(message: str, key: str = DEMO_KEY) -> str:
    from textguard.functions.keyed import hmac_pads

    inner, outer = (pad.hex() for pad in hmac_pads(key))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


def framed_sql(*parts: str) -> str:
    return " || ".join(f"CAST(length({p}) AS VARCHAR) || ':' || {p}" for p in parts)


def token_sql(conversation: str, policy: Policy, epoch: str = "'0'") -> str:
    labels = " ".join(
        f"WHEN rule_id = {quoted(r['id'])} THEN {quoted(r['token_prefix'].upper())}"
        for r in policy.rules
        if r.get("token_prefix")
    )
    label = f"CASE {labels} ELSE upper(category) END" if labels else "upper(category)"
    message = framed_sql(conversation, epoch, "category", "value")
    return f"'[' || {label} || '_' || left({hmac_sql(message)}, 16) || ']'"


def redacted_ctes(
    source: str,
    policy: Policy,
    conversation: str = "CAST(id AS VARCHAR)",
    token: str | None = None,
    token_ctes: str = "",
    more: str = "",
) -> str:
    """CTEs ending in ``redacted (id, text, allowed, redacted, n_findings, blocked)``. ``token`` is the
    placeholder's SQL, which may use ``token_ctes``."""
    token = token or token_sql(conversation, policy)
    return f"""
    src AS ({source}), {resolved_ctes('SELECT id, text FROM src', policy, more)},
    {token_ctes} pieces AS (
      SELECT k.id, k.start, k."end", k.action, k.category,
             substr(k.text, lag(k."end", 1, 0) OVER w + 1, k.start - lag(k."end", 1, 0) OVER w)
             || CASE action WHEN 'mask' THEN '[' || upper(category) || '_REDACTED]'
                            WHEN 'tokenize' THEN {token} ELSE value END AS piece
      FROM (SELECT kept.*, src.* EXCLUDE (id) FROM kept JOIN src USING (id)) k
      WINDOW w AS (PARTITION BY k.id ORDER BY k.start)),
    joined AS (SELECT id, string_agg(piece, '' ORDER BY start) AS head, max("end") AS stop, count(*) AS n_findings,
                      list_sort(list_distinct(list(category) FILTER (action = 'block'))) AS blocked
               FROM pieces GROUP BY id),
    redacted AS (
      SELECT src.* EXCLUDE (text), src.text, coalesce(len(blocked), 0) = 0 AS allowed,
             CASE WHEN coalesce(len(blocked), 0) = 0 THEN coalesce(head || substr(text, stop + 1), text) END AS redacted,
             coalesce(n_findings, 0) AS n_findings, coalesce(array_to_string(blocked, ','), '') AS blocked
      FROM src LEFT JOIN joined USING (id))"""
