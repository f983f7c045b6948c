"""Redaction of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textguard.operators.tokens import token_key
from textguard.plans.redact import redact_requests, redact_texts
from textguard.policy import Policy
from textguard.sources.sinks import write_once


def redact_text_stream(
    stream: DataFrame, policy: Policy, conversation: Column, key: str, text: str = "text"
) -> DataFrame:
    """Row-wise redaction of a streaming text table, in append mode: no state, no shuffle."""
    return redact_texts(stream, policy, conversation, key, text)


def redacted_requests(stream: DataFrame, policy: Policy, key: str | None = None) -> DataFrame:
    """Requests of a stream, redacted row by row in append mode: no state, no shuffle. ``sink`` says where a row belongs."""
    done = redact_requests(stream, policy, key or token_key(stream.sparkSession))
    return done.withColumn("sink", F.when(F.col("allowed"), "allowed").otherwise("quarantine"))


def redact_request_stream(
    stream: DataFrame,
    policy: Policy,
    folder: str,
    checkpoint: str,
    key: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Requests in, three tables out (allowed, quarantine, audit).

    Three tables need a step per micro-batch; where one table partitioned by ``sink`` will do, write ``redacted_requests``
    in append mode. Batches are written under their own folder, which makes a replayed batch replace itself. Set the token key
    in the session for tokens that stay stable across restarts.
    """
    secret = key or token_key(stream.sparkSession)

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_once(redact_requests(batch, policy, secret), folder, batch=batch_id)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
