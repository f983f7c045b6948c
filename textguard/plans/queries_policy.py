"""Policy lookups, rule tables, decisions, audit and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.operators.checks import changed_without_finding, escaped_requests, has_placeholder, leaks, replay_failures
from textguard.operators.detect import detect
from textguard.operators.hits import LABELS, attach_hits, usable_hits
from textguard.operators.reports import (
    case_report,
    decision_summary,
    explode_findings,
    finding_counts,
    json_lines,
    markdown_lines,
    report_header,
    roll_up,
    size_stats,
)
from textguard.operators.rules import (
    RULE_SCHEMA,
    actions_for,
    layered_actions,
    rule_hits,
    rule_problems,
    rules_from_packs,
    what_if,
)
from textguard.plans.catalog import (
    DEMO_KEY,
    DOCUMENTS_SQL,
    SEEDED_SQL,
    documents,
    findings_sql,
    mask_policy,
    query,
    quoted,
    redacted_ctes,
    regex_policy,
    resolved_ctes,
    seeded_turns,
    table,
)
from textguard.plans.redact import audit_table, inspect_texts, redact_texts
from textguard.policy import ACTION_RANK, DEFAULT_ACTIONS, PROFILES, SEVERITY_RANK, Policy, action_table

_FULL = regex_policy(secrets=True, rules=True)
_TURNS_FOUND = findings_sql(SEEDED_SQL, _FULL)


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


_PROFILE_POLICIES = [Policy.builtin(name) for name in PROFILES]
_PROFILE_ROWS = [(p.profile, c, a) for p in _PROFILE_POLICIES for c, a in p.actions.items()]


@query(
    "policy_action_join",
    f"""SELECT f.category, coalesce(v.action, 'audit') AS action, count(*) AS n_findings
        FROM ({_TURNS_FOUND}) AS f LEFT JOIN {_values([r[1:] for r in _PROFILE_ROWS if r[0] == 'finance'], 'category, action')}
        ON f.category = v.category GROUP BY 1, 2""",
)
def policy_action_join(spark, folder):
    found = explode_findings(detect(seeded_turns(spark, folder), _FULL), ["id"], "findings")
    counts = finding_counts(found, ["category"])
    actions = action_table(spark, [Policy.builtin("finance")]).select("category", "action")
    return actions_for(counts, actions).select("category", "action", "n_findings")


@query(
    "policy_what_if",
    f"""SELECT p.profile, coalesce(v.action, 'audit') AS action, CAST(count(*) AS BIGINT) AS n_findings
        FROM ({_TURNS_FOUND}) AS f CROSS JOIN {_values([(p,) for p in PROFILES], 'profile').replace(' v(', ' p(')}
        LEFT JOIN {_values(_PROFILE_ROWS, 'profile, category, action')} ON v.profile = p.profile AND v.category = f.category
        GROUP BY 1, 2""",
)
def policy_what_if(spark, folder):
    found = explode_findings(detect(seeded_turns(spark, folder), _FULL), ["id"], "findings")
    return what_if(found, _PROFILE_POLICIES)


@query(
    "policy_what_if_strict",
    f"""SELECT p.profile, coalesce(v.action, 'audit') AS action, CAST(count(*) AS BIGINT) AS n_findings
        FROM ({_TURNS_FOUND}) AS f CROSS JOIN {_values([(p,) for p in PROFILES], 'profile').replace(' v(', ' p(')}
        LEFT JOIN {_values([(p.profile, c, a) for n in PROFILES for p in [Policy.builtin(n, strict=True)] for c, a in p.actions.items()], 'profile, category, action')}
        ON v.profile = p.profile AND v.category = f.category GROUP BY 1, 2""",
)
def policy_what_if_strict(spark, folder):
    found = explode_findings(detect(seeded_turns(spark, folder), _FULL), ["id"], "findings")
    return what_if(found, [Policy.builtin(name, strict=True) for name in PROFILES])


# Rules made of part rows: some good, some broken in each way that the checks know.
_PART_RULES = """
  SELECT CASE WHEN p_partkey % 11 = 0 THEN 'part ' || CAST(p_partkey AS STRING)
              WHEN p_partkey % 13 = 0 THEN p_brand ELSE 'part_' || CAST(p_partkey AS STRING) END AS id,
         CASE WHEN p_partkey % 17 = 0 THEN 'glob' WHEN p_partkey % 2 = 0 THEN 'regex' ELSE 'keyword' END AS type,
         CASE WHEN p_partkey % 2 = 0 AND p_partkey % 19 <> 0 THEN 'PN-[0-9]{' || CAST(p_size AS STRING) || '}' END AS pattern,
         p_name AS word,
         p_brand AS category,
         CASE p_size % 6 WHEN 0 THEN 'scrub' WHEN 1 THEN 'block' WHEN 2 THEN 'mask' WHEN 3 THEN 'tokenize' WHEN 4 THEN 'allow' END AS action,
         CASE WHEN p_partkey % 23 = 0 THEN 'severe' WHEN p_partkey % 3 = 0 THEN 'high' END AS severity,
         p_partkey AS place
  FROM part"""


def _part_rules(spark, folder):
    table(spark, folder, "part").createOrReplaceTempView("part")
    rules = spark.sql(_PART_RULES)
    return rules.withColumn("values", F.when(F.col("place") % 29 != 0, F.array("word")))


@query(
    "rule_lint",
    f"""WITH r AS ({_PART_RULES}) SELECT id, problem FROM (
      SELECT id, 'bad id characters' AS problem FROM r WHERE NOT regexp_full_match(id, '[A-Za-z0-9_.:-]+')
      UNION ALL SELECT id, 'unknown type' FROM r WHERE type NOT IN ('regex', 'keyword')
      UNION ALL SELECT id, 'unknown action' FROM r WHERE action = 'scrub'
      UNION ALL SELECT id, 'unknown severity' FROM r WHERE severity = 'severe'
      UNION ALL SELECT id, 'empty pattern' FROM r WHERE type = 'regex' AND pattern IS NULL
      UNION ALL SELECT id, 'empty values' FROM r WHERE type = 'keyword' AND place % 29 = 0
      UNION ALL SELECT id, 'duplicate id' FROM r GROUP BY id HAVING count(*) > 1) AS q""",
)
def rule_lint(spark, folder):
    return rule_problems(_part_rules(spark, folder))


@query(
    "rule_pack_union",
    f"""WITH r AS ({_PART_RULES}) SELECT id, type, category, action, severity FROM (
      SELECT id, type, category, action, severity FROM r WHERE place % 3 = 0
      UNION ALL SELECT 'sample_keyword_' || replace(lower(word), ' ', '_'), 'keyword', 'sample_keyword', 'tokenize', 'medium' FROM r WHERE place % 3 = 1
      UNION ALL SELECT id, 'regex', category, action, severity FROM r WHERE place % 3 = 2) AS q""",
)
def rule_pack_union(spark, folder):
    rule = F.struct(
        "id", "type", "pattern", "values", "category", "action", "severity",
        F.lit(None).cast("string").alias("token_prefix"), F.lit(None).cast("boolean").alias("audit_only"),
    ).cast(RULE_SCHEMA)
    part = F.col("place") % 3
    packs = _part_rules(spark, folder).select(
        F.when(part == 0, F.array(rule)).alias("rules"),
        F.when(part == 1, F.array("word")).alias("keywords"),
        F.when(part == 2, F.array(rule)).alias("custom_regex"),
    )
    return rules_from_packs(packs).select("id", "type", "category", "action", "severity")


@query(
    "layered_actions",
    f"""WITH r AS ({_PART_RULES}), layers AS (
      SELECT category, action, 0 AS layer, CAST(0 AS BIGINT) AS place FROM {_values(list(DEFAULT_ACTIONS.items()), 'category, action')}
      UNION ALL SELECT p_brand, 'audit', 1, 0 FROM (SELECT DISTINCT p_brand FROM part) AS b
      UNION ALL SELECT category, action, 2, place FROM r WHERE action IS NOT NULL)
      SELECT category, arg_max(action, layer * CAST(1000000000000 AS BIGINT) + place) AS action FROM layers GROUP BY category""",
)
def layered(spark, folder):
    defaults = spark.createDataFrame(list(DEFAULT_ACTIONS.items()), "category string, action string")
    rules = _part_rules(spark, folder)
    brands = rules.select("category", F.lit("audit").alias("action")).distinct()
    return layered_actions(defaults, brands, rules)


# A long pack: every word of the texts' benchmark and of the parts' names as a pattern or a keyword, and every customer's name.
_PACK_WORDS = """SELECT DISTINCT w FROM (SELECT explode(split(lower(text), '[^a-z]+')) AS w FROM benchmark
  UNION ALL SELECT explode(split(lower(p_name), '[^a-z]+')) FROM part) WHERE length(w) >= 3"""
_PACK_WORDS_SQL = """SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark
  UNION ALL SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) FROM part) AS u WHERE length(w) >= 3"""


def _pack(spark, folder):
    for name in ("benchmark", "part", "customer"):
        table(spark, folder, name).createOrReplaceTempView(name)
    missing = "CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS action, CAST(NULL AS STRING) AS severity"
    more = "CAST(NULL AS STRING) AS token_prefix, CAST(NULL AS BOOLEAN) AS audit_only"
    return spark.sql(f"""
      SELECT 'word.' || w AS id, 'regex' AS type, '\\\\b' || w || '\\\\b' AS pattern, CAST(NULL AS ARRAY<STRING>) AS values, {missing}, {more}
      FROM ({_PACK_WORDS})
      UNION ALL SELECT 'customer.' || CAST(c_custkey AS STRING), 'keyword', NULL, array(c_name, 'cust' || CAST(c_custkey AS STRING) || '!'), {missing}, {more}
      FROM customer""")


@query(
    "rule_pack_hits",
    f"""WITH t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM ({DOCUMENTS_SQL}) AS d),
        k AS (SELECT 'customer.' || CAST(c_custkey AS VARCHAR) AS rule_id, unnest([lower(c_name), 'cust' || CAST(c_custkey AS VARCHAR) || '!']) AS v
              FROM customer)
        SELECT id, 'word.' || w AS rule_id, count(*) AS n FROM t SEMI JOIN ({_PACK_WORDS_SQL}) AS p ON p.w = t.w GROUP BY ALL
        UNION ALL SELECT id, rule_id, sum((length(text) - length(replace(lower(text), v, ''))) // length(v))::BIGINT
        FROM ({DOCUMENTS_SQL}) AS d JOIN k ON contains(lower(d.text), k.v) GROUP BY ALL""",
)
def rule_pack_hits(spark, folder):
    """A rule table of thousands of rules over all documents: how often each rule finds something in each."""
    found = rule_hits(documents(spark, folder), _pack(spark, folder), "id")
    return found.groupBy("id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


# -- decisions and audit ------------------------------------------------------------------------

_TURNS_KEPT = f"WITH RECURSIVE {resolved_ctes(SEEDED_SQL, _FULL)}"


@query(
    "audit_table",
    f"""{_TURNS_KEPT} SELECT id, category, severity, detector, action, rule_id, false AS audit_only,
        false AS normalized, 'enforce' AS policy_mode, {quoted(_FULL.fingerprint())} AS policy_hash FROM kept""",
)
def audit(spark, folder):
    items = inspect_texts(seeded_turns(spark, folder), _FULL)
    return audit_table(items, _FULL, ["id"]).drop("confidence", "reason")


_AUDIT_ONLY = regex_policy(secrets=True, rules=True)
_AUDIT_ONLY.mode = "audit"


@query(
    "audit_mode_changes_nothing",
    f"""{_TURNS_KEPT} SELECT s.id, true AS allowed, s.text AS redacted, count(k.id) AS n_findings
        FROM ({SEEDED_SQL}) AS s LEFT JOIN kept AS k ON k.id = s.id GROUP BY ALL""",
)
def audit_mode(spark, folder):
    done = redact_texts(seeded_turns(spark, folder), _AUDIT_ONLY, F.col("id").cast("string"), DEMO_KEY)
    return done.select("id", "allowed", "redacted", F.size("resolved").cast("bigint").alias("n_findings"))


@query(
    "rule_audit_only",
    f"""{_TURNS_KEPT} SELECT action, category, category = 'client_codename' AS audit_only, count(*) AS n_findings
        FROM kept GROUP BY ALL""",
)
def rule_audit_only(spark, folder):
    policy = regex_policy(secrets=True, rules=True)
    policy.rules = [{**r, "audit_only": True} if r["id"] == "client_codename" else r for r in policy.rules]
    items = inspect_texts(seeded_turns(spark, folder), policy)
    return finding_counts(audit_table(items, policy, ["id"]), ["action", "category", "audit_only"])


@query(
    "request_decision",
    f"""{_TURNS_KEPT} SELECT t.conv_id, coalesce(bool_and(k.action <> 'block'), true) AS allowed,
          coalesce(string_agg(DISTINCT k.category, ',' ORDER BY k.category) FILTER (k.action = 'block'), '') AS blocked,
          count(k.id) AS n_findings
        FROM conversations AS t LEFT JOIN kept AS k ON k.id = t.conv_id * 1000 + t.turn GROUP BY t.conv_id""",
)
def request_decision(spark, folder):
    """A conversation as one request: one blocked turn blocks it."""
    rolled = roll_up(inspect_texts(seeded_turns(spark, folder), _FULL), ["conv_id"], _FULL)
    return rolled.select("conv_id", "allowed", F.array_join("blocked_categories", ",").alias("blocked"), "n_findings")


@query(
    "quarantine",
    f"""{_TURNS_KEPT} SELECT id, string_agg(DISTINCT category, ',' ORDER BY category) AS blocked
        FROM kept WHERE action = 'block' GROUP BY id""",
)
def quarantined(spark, folder):
    items = inspect_texts(seeded_turns(spark, folder), _FULL)
    return items.where(~F.col("allowed")).select("id", F.array_join("blocked_categories", ",").alias("blocked"))


_REDACTED = f"WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _FULL)}"


@query(
    "report_summary",
    f"""{_REDACTED} SELECT id AS "case", allowed, CASE WHEN blocked = '' THEN '-' ELSE blocked END AS blocked, n_findings,
        coalesce(redacted, '[blocked locally]') AS redacted_payload FROM redacted""",
)
def report_summary(spark, folder):
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("id").cast("string"), DEMO_KEY)
    cases = done.select(
        "id", "allowed", "blocked_categories", F.size("resolved").cast("bigint").alias("n_findings"),
        F.col("redacted").alias("redacted_payload"),
    )
    return case_report(cases, "id")


_REPORT_HEAD = ["# Redaction report", "", *[f"- {k}: {v}" for k, v in report_header(_FULL).items()], "",
                "| Case | Allowed | Blocked categories | Findings |", "|---|---|---|---|"]


@query(
    "report_markdown",
    f"""WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _FULL)} SELECT '| ' || CAST(id AS VARCHAR) || ' | ' || CAST(allowed AS VARCHAR) || ' | '
        || CASE WHEN blocked = '' THEN '-' ELSE blocked END || ' | ' || CAST(n_findings AS VARCHAR) || ' |' AS value FROM redacted
        UNION ALL SELECT unnest([{", ".join(quoted(line) for line in _REPORT_HEAD)}])""",
)
def report_markdown(spark, folder):
    return markdown_lines(report_summary(spark, folder), _FULL)


@query(
    "report_json",
    f"""WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _FULL)} SELECT CAST(to_json({{'case': id, 'allowed': allowed,
        'blocked': CASE WHEN blocked = '' THEN [] ELSE string_split(blocked, ',') END, 'n_findings': n_findings,
        'profile': {quoted(_FULL.profile)}, 'mode': {quoted(_FULL.mode)}}}) AS VARCHAR) AS value FROM redacted""",
)
def report_json(spark, folder):
    return json_lines(report_summary(spark, folder), _FULL)


@query(
    "size_stats",
    """SELECT lang, count(*) AS n_texts, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes,
         quantile_cont(strlen(text), 0.5) AS median_bytes, CAST(max(strlen(text)) AS INTEGER) AS max_bytes
       FROM documents GROUP BY lang""",
)
def sizes(spark, folder):
    return size_stats(table(spark, folder, "documents"), ["lang"])


@query(
    "decision_summary",
    f"""{_TURNS_KEPT}, per_turn AS (SELECT t.role, t.conv_id, t.turn, coalesce(bool_and(k.action <> 'block'), true) AS ok, count(k.id) AS n
          FROM conversations AS t LEFT JOIN kept AS k ON k.id = t.conv_id * 1000 + t.turn GROUP BY ALL)
        SELECT role, bool_and(ok) AS allowed, NOT bool_or(ok) AS blocked,
               CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_findings, CAST(max(n) AS INTEGER) AS max_findings
        FROM per_turn GROUP BY role""",
)
def decisions(spark, folder):
    return decision_summary(inspect_texts(seeded_turns(spark, folder), _FULL), ["role"])


# -- outside hits -------------------------------------------------------------------------------

# Hits derived from labelled documents: a person at the start, a date further in, an address that goes on after the text, one that
# starts after it, an unknown label.
_HITS = """
  SELECT doc_id AS id, 'private_person' AS label, 0 AS start, 5 + quality AS stop, CAST(0.5 AS DOUBLE) AS score FROM labels
  UNION ALL SELECT doc_id, 'private_date', 10 + toxic, 18, CAST(NULL AS DOUBLE) FROM labels WHERE toxic = 0
  UNION ALL SELECT doc_id, 'private_address', 60 + quality, 1000000, CAST(0.75 AS DOUBLE) FROM labels WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'account_number', 1000000, 1000004, CAST(1 AS DOUBLE) FROM labels
  UNION ALL SELECT doc_id, 'weather', 2, 4, CAST(1 AS DOUBLE) FROM labels
  UNION ALL SELECT doc_id, 'secret', NULL, 4, CAST(1 AS DOUBLE) FROM labels"""


def _hits(spark, folder):
    table(spark, folder, "labels").createOrReplaceTempView("labels")
    return spark.sql(_HITS).withColumnRenamed("stop", "end")


_USABLE = f"""SELECT h.id, label AS category, start, least(stop, length(d.text)) AS "end",
  substr(d.text, start + 1, stop - start) AS value, score
  FROM ({_HITS}) AS h JOIN ({DOCUMENTS_SQL}) AS d ON d.id = h.id
  WHERE label <> 'weather' AND start < stop AND start < length(d.text)"""


@query("external_hits", f"SELECT * EXCLUDE (score), coalesce(score, 1) AS confidence FROM ({_USABLE}) AS u")
def external_hits(spark, folder):
    items = attach_hits(documents(spark, folder), _hits(spark, folder), "id")
    return items.select("id", F.inline("hits")).select("id", "category", "start", "end", "value", "confidence")


_HIT_POLICY = regex_policy(secrets=True, rules=True)
_HIT_POLICY.detectors.privacy_filter = {"enabled": True, "mode": "local_service", "url": "landed"}
_ACTION_RANKS = ", ".join(f"({quoted(c)}, {quoted(_HIT_POLICY.action_for(c))}, {ACTION_RANK[_HIT_POLICY.action_for(c)]})" for c in LABELS)
_HIT_FINDINGS = f"""SELECT id, start, "end", value, u.category, 'high' AS severity, 'privacy_filter' AS detector, NULL AS rule_id,
  action, arank, {SEVERITY_RANK["high"]} AS srank, 1000 AS ord, row_number() OVER (PARTITION BY id ORDER BY start, "end", u.category, score) AS i
  FROM ({_USABLE}) AS u JOIN (VALUES {_ACTION_RANKS}) AS a(category, action, arank) ON a.category = u.category"""


@query(
    "external_hits_redacted",
    f"""WITH RECURSIVE {redacted_ctes(DOCUMENTS_SQL, _HIT_POLICY, more=_HIT_FINDINGS)}
        SELECT id, allowed, redacted, CAST(n_findings AS INTEGER) AS n_findings FROM redacted""",
)
def external_hits_redacted(spark, folder):
    """Landed hits beside the detectors that SQL can repeat."""
    items = attach_hits(documents(spark, folder), _hits(spark, folder), "id")
    done = redact_texts(items, _HIT_POLICY, F.col("id").cast("string"), DEMO_KEY, hits="hits")
    return done.select("id", "allowed", "redacted", F.size("resolved").alias("n_findings"))


@query("external_hit_labels", f"SELECT category, count(*) AS n FROM ({_USABLE}) AS u GROUP BY category")
def external_hit_labels(spark, folder):
    usable = usable_hits(_hits(spark, folder), documents(spark, folder), "id")
    return usable.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# -- checks -------------------------------------------------------------------------------------


@query(
    "leak_check_seeded",
    f"""SELECT t.id, 'user' || CAST(n.conv_id AS VARCHAR) AS name FROM ({SEEDED_SQL}) AS t
        JOIN (SELECT DISTINCT conv_id FROM conversations) AS n ON contains(t.text, 'user' || CAST(n.conv_id AS VARCHAR) || '@example.com')""",
)
def leak_check_seeded(spark, folder):
    """Every address that the turns may hold, looked for in all unredacted turns."""
    turns = seeded_turns(spark, folder)
    name = F.concat(F.lit("user"), F.col("conv_id").cast("string"))
    needles = turns.select(name.alias("name"), F.concat(name, F.lit("@example.com")).alias("value")).distinct()
    return leaks(turns, needles, "id", "text")


@query(
    "leak_check",
    """SELECT d.doc_id AS id, CAST(b.item_id AS VARCHAR) AS name
       FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text) AND b.text <> ''""",
)
def leak_check(spark, folder):
    """Which benchmark passages appear word for word in which documents."""
    needles = table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("value"))
    bodies = documents(spark, folder).withColumnRenamed("text", "body")
    return leaks(bodies, needles, "id")


@query(
    "leak_check_redacted",
    f"""{_REDACTED}, needles AS (SELECT DISTINCT 'user' || CAST(conv_id AS VARCHAR) || '@example.com' AS value FROM conversations)
        SELECT r.id, n.value AS name FROM redacted AS r JOIN needles AS n ON contains(r.redacted, n.value)""",
)
def leak_check_redacted(spark, folder):
    """No seeded address survives redaction."""
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("id").cast("string"), DEMO_KEY)
    address = F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.com"))
    needles = table(spark, folder, "conversations").select(address.alias("name"), address.alias("value")).distinct()
    return leaks(done.where("allowed").select("id", F.col("redacted").alias("body")), needles, "id")


@query(
    "replay_check",
    f"""{_REDACTED} SELECT id, problem FROM (
          SELECT id, CASE WHEN allowed <> ((conv_id * 7 + turn) % 8 <> 2) THEN 'decision' END AS problem FROM redacted
          UNION ALL SELECT id, CASE WHEN contains(coalesce(redacted, ''), '@example.com') THEN 'forbidden text' END FROM redacted
          UNION ALL SELECT id, CASE WHEN NOT contains(coalesce(redacted, ''), '[') THEN 'missing text' END FROM redacted) AS q
        WHERE problem IS NOT NULL""",
)
def replay_check(spark, folder):
    """Every turn against what its seed leads one to expect; turns without a seed miss a placeholder."""
    turns = seeded_turns(spark, folder)
    done = redact_texts(turns, _FULL, F.col("id").cast("string"), DEMO_KEY)
    results = done.select("id", "allowed", F.col("redacted").alias("body"))
    expected = turns.select(
        "id",
        ((F.col("conv_id") * 7 + F.col("turn")) % 8 != 2).alias("expect_allowed"),
        F.array(F.lit("@example.com")).alias("must_not_contain"),
        F.array(F.lit("[")).alias("must_contain"),
    )
    return replay_failures(results, expected, "id")


@query(
    "placeholder_shape",
    f"""{_REDACTED} SELECT id, regexp_matches(redacted, '\\[[A-Z0-9_.:-]+_(?:[0-9a-f]{{16}}|[0-9]{{3,}})\\]') AS has_token
        FROM redacted WHERE allowed""",
)
def placeholder_shape(spark, folder):
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("id").cast("string"), DEMO_KEY)
    return done.where("allowed").select("id", has_placeholder(F.col("redacted")).alias("has_token"))


@query(
    "blocked_no_egress",
    f"{_REDACTED} SELECT id FROM redacted WHERE NOT allowed AND redacted IS NOT NULL",
)
def blocked_no_egress(spark, folder):
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("id").cast("string"), DEMO_KEY)
    return escaped_requests(done.where(~F.col("allowed")), done.where(F.col("redacted").isNotNull()), "id")


@query(
    "benign_unchanged",
    f"{_REDACTED} SELECT id FROM redacted WHERE allowed AND n_findings = 0 AND redacted <> text",
)
def benign_unchanged(spark, folder):
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("id").cast("string"), DEMO_KEY)
    return changed_without_finding(done, "id")


@query(
    "blocked_egress_planted",
    f"{_REDACTED} SELECT id FROM redacted WHERE NOT allowed AND conv_id % 3 = 0",
)
def blocked_egress_planted(spark, folder):
    """The egress check where a third of the conversations send all they have."""
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("id").cast("string"), DEMO_KEY)
    sent = done.where(F.col("redacted").isNotNull() | (F.col("conv_id") % 3 == 0))
    return escaped_requests(done.where(~F.col("allowed")), sent, "id")


@query(
    "benign_changed_planted",
    f"{_REDACTED} SELECT id FROM redacted WHERE allowed AND n_findings = 0 AND conv_id % 3 = 0",
)
def benign_changed_planted(spark, folder):
    """The check of texts without findings where a third of the conversations come back changed."""
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("id").cast("string"), DEMO_KEY)
    spoilt = F.when(F.col("conv_id") % 3 == 0, F.concat("redacted", F.lit("!"))).otherwise(F.col("redacted"))
    return changed_without_finding(done.withColumn("redacted", spoilt), "id")


@query(
    "mask_with_mode",
    f"""WITH RECURSIVE {redacted_ctes(SEEDED_SQL, mask_policy(secrets=True, rules=True))}
        SELECT id, redacted FROM redacted WHERE n_findings > 0""",
)
def mask_with_mode(spark, folder):
    policy = mask_policy(secrets=True, rules=True)
    done = redact_texts(seeded_turns(spark, folder), policy, F.col("id").cast("string"), DEMO_KEY)
    return done.where(F.size("resolved") > 0).select("id", "redacted")
