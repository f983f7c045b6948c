"""Outputs: rewritten data, quarantine, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.plans.redact import quarantine


def write_requests(requests: DataFrame, folder: str, request_id: str = "request_id", mode: str = "append") -> None:
    """Three tables: ``allowed`` payloads, ``quarantine`` (no text), ``audit`` (no values).

    ``requests`` feeds three writes; pass materialized data (or use ``write_once``) if it is costly.
    """
    requests.where("allowed").select(request_id, "redacted_payload", "n_findings").write.mode(mode).parquet(
        f"{folder}/allowed"
    )
    quarantine(requests, request_id).write.mode(mode).parquet(f"{folder}/quarantine")
    write_audit(requests, folder, request_id, mode)


def write_audit(requests: DataFrame, folder: str, request_id: str = "request_id", mode: str = "append") -> None:
    records = requests.select(request_id, F.inline("audit"))
    records.write.mode(mode).partitionBy("action").parquet(f"{folder}/audit")


def write_once(requests: DataFrame, folder: str, request_id: str = "request_id", batch: int = 0) -> None:
    """Run the pipeline once into a staged table, then split it. Every write of a batch replaces the
    batch's own folder, so a retried batch leaves no duplicates."""
    staged = f"{folder}/staged/batch={batch}"
    requests.write.mode("overwrite").parquet(staged)
    done = requests.sparkSession.read.parquet(staged)
    done.where("allowed").select(request_id, "redacted_payload", "n_findings").write.mode("overwrite").parquet(
        f"{folder}/allowed/batch={batch}"
    )
    quarantine(done, request_id).write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch}")
    done.select(request_id, F.inline("audit")).write.mode("overwrite").parquet(f"{folder}/audit/batch={batch}")
