"""Reports over findings, audit records and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.hits import LABELS
from textguard.patterns import BUILTIN, SECRETS
from textguard.policy import Policy


def explode_findings(items: DataFrame, keys: list[str], findings: str = "resolved") -> DataFrame:
    """One row per finding, without its value."""
    return items.select(*keys, F.inline(findings)).drop("value")


def finding_counts(findings: DataFrame, by: list[str], totals: bool = False) -> DataFrame:
    grouped = findings.rollup(*by) if totals else findings.groupBy(*by)
    return grouped.agg(F.count(F.lit(1)).alias("n_findings"))


def known_categories(policy: Policy) -> list[str]:
    named = {p.category for p in BUILTIN + SECRETS} | set(policy.actions) | set(LABELS.values())
    return sorted(named | {r.get("category", r["id"]) for r in policy.rules})


def roll_up(items: DataFrame, by: list[str], policy: Policy) -> DataFrame:
    """Decision per group of texts: ``allowed``, ``blocked_categories`` (sorted) and ``n_findings``.

    A policy knows its categories, so the distinct union is one flag per category: constant state
    that combines map-side, however many texts a group has.
    """
    categories = known_categories(policy)
    flags = [F.bool_or(F.array_contains("blocked_categories", c)).alias(f"_{i}") for i, c in enumerate(categories)]
    rolled = items.groupBy(*by).agg(
        F.bool_and("allowed").alias("allowed"),
        F.sum(F.size("resolved")).alias("n_findings"),
        *flags,
    )
    named = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(c)) for i, c in enumerate(categories)]))
    return rolled.select(*by, "allowed", named.alias("blocked_categories"), "n_findings")


def case_report(requests: DataFrame, case: str) -> DataFrame:
    """One line per request: decision, categories, number of findings, rewritten payload."""
    return requests.select(
        F.col(case).alias("case"),
        "allowed",
        F.coalesce(F.nullif(F.array_join("blocked_categories", ", "), F.lit("")), F.lit("-")).alias("blocked"),
        F.col("n_findings"),
        F.when(F.col("allowed"), F.col("redacted_payload"))
        .otherwise(F.lit("[blocked locally]"))
        .alias("redacted_payload"),
    )


def report_header(policy: Policy) -> dict[str, str]:
    switches = ", ".join(f"{k}={v}" for k, v in vars(policy.detectors).items())
    return {"profile": policy.profile, "mode": policy.mode, "detectors": switches}


def json_lines(report: DataFrame, policy: Policy) -> DataFrame:
    """The report for machines: one JSON object per case, with the policy that decided it. Nothing is sorted or gathered."""
    blocked = F.when(F.col("blocked") == "-", F.array().cast("array<string>")).otherwise(F.split("blocked", ", "))
    head = report_header(policy)
    case = F.struct(
        F.col("case").alias("case"),
        F.col("allowed").alias("allowed"),
        blocked.alias("blocked"),
        F.col("n_findings").alias("n_findings"),
        F.lit(head["profile"]).alias("profile"),
        F.lit(head["mode"]).alias("mode"),
    )
    return report.select(F.to_json(case).alias("value"))


def markdown_lines(report: DataFrame, policy: Policy) -> DataFrame:
    """The report as ordered lines of a markdown table: write with ``text``. Header lines are fixed;
    body lines stay distributed."""
    spark = report.sparkSession
    head = ["# Redaction report", "", *[f"- {k}: {v}" for k, v in report_header(policy).items()], ""]
    head += ["| Case | Allowed | Blocked categories | Findings |", "|---|---|---|---|"]
    top = spark.createDataFrame([(0, f"{i:03d}", line) for i, line in enumerate(head)], "part int, place string, value string")
    row = F.concat_ws(" | ", F.col("case").cast("string"), F.col("allowed").cast("string"), "blocked", F.col("n_findings").cast("string"))
    body = report.select(
        F.lit(1).alias("part"),
        F.col("case").cast("string").alias("place"),
        F.concat(F.lit("| "), row, F.lit(" |")).alias("value"),
    )
    return top.unionByName(body).orderBy("part", "place").select("value")


def size_stats(items: DataFrame, by: list[str], text: str = "text", exact: bool = True) -> DataFrame:
    """Bytes per group: count, total, median and maximum."""
    size = F.octet_length(text)
    median = F.percentile(size, F.lit(0.5)) if exact else F.approx_percentile(size, 0.5).cast("double")
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(size).alias("total_bytes"),
        median.alias("median_bytes"),
        F.max(size).alias("max_bytes"),
    )


def decision_summary(items: DataFrame, by: list[str]) -> DataFrame:
    """Per group: are all allowed, is every one blocked, and findings per text."""
    return items.groupBy(*by).agg(
        F.bool_and("allowed").alias("allowed"),
        (~F.bool_or("allowed")).alias("blocked"),
        F.percentile(F.size("resolved"), F.lit(0.5)).alias("median_findings"),
        F.max(F.size("resolved")).alias("max_findings"),
    )
