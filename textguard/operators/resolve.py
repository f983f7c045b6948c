"""Overlap resolution: keep one finding where several claim the same characters.

Findings are ordered by start (longer, stronger action, higher severity first) and swept once. As kept
findings never overlap each other, a new one can only clash with the latest kept one, so the sweep
carries that single finding and is linear in the number of findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.arrays import computed_once, scan
from textguard.operators.detect import FINDING_TYPE, FINDINGS_TYPE
from textguard.policy import Policy, severity_rank_column

_RANKED_TYPE = (
    f"struct<start:int,shorter:int,action:int,severity:int,place:int,finding:{FINDING_TYPE}>"
)


def drop_allowed(findings: Column, allowlist: list[str]) -> Column:
    """Remove findings whose value contains an allowed string."""
    if not allowlist:
        return findings

    def allowed(f: Column) -> Column:
        test = F.lit(False)
        for entry in allowlist:
            test = test | F.contains(f["value"], F.lit(entry))
        return test

    return F.filter(findings, lambda f: ~allowed(f))


def _ranked(findings: Column, policy: Policy) -> Column:
    """Findings with sort keys first: natural struct order is the sweep order."""
    return F.array_sort(
        F.transform(
            findings,
            lambda f, i: F.struct(
                f["start"].alias("start"),
                (f["start"] - f["end"]).alias("shorter"),
                (-policy.action_rank_column(f["category"])).alias("action"),
                (-severity_rank_column(f["severity"])).alias("severity"),
                i.alias("place"),
                f.alias("finding"),
            ),
        )
    )


def _strength(ranked: Column) -> Column:
    return F.struct(ranked["action"], ranked["severity"], ranked["shorter"])


def resolve_findings(findings: Column, policy: Policy) -> Column:
    """Disjoint findings in text order. A clash goes to the stronger action, then severity, then
    length, then to the later finding; the loser is dropped whole."""
    none = F.lit(None).cast(_RANKED_TYPE)
    nothing = F.array().cast(FINDINGS_TYPE)

    def step(pending: Column, new: Column) -> Column:
        held = pending["finding"]
        apart = (new["start"] >= held["end"]) | (held["start"] >= new["finding"]["end"])
        new_wins = _strength(new) <= _strength(pending)
        return F.struct(
            F.when(pending.isNull() | apart | new_wins, new).otherwise(pending).alias("state"),
            F.when(pending.isNotNull() & apart, F.array(held)).otherwise(nothing).alias("emit"),
        )

    swept = scan(_ranked(findings, policy), none, step, FINDINGS_TYPE)
    merged = F.transform(
        F.array(swept), lambda s: F.concat(s["out"], F.array(s["state"]["finding"]))
    ).getItem(0)
    return F.when(F.size(findings) > 1, merged).otherwise(findings)


def resolve(df: DataFrame, policy: Policy, findings: str = "findings", output: str = "resolved") -> DataFrame:
    """Apply the allowlist, then resolve overlaps."""
    return df.withColumn("_kept", drop_allowed(F.col(findings), policy.allowlist)).withColumn(
        output, computed_once(resolve_findings(F.col("_kept"), policy))
    ).drop("_kept")
