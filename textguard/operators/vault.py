"""How long a conversation's tokens live: idle time-out and a cap on live conversations."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions.skew import lookup_join, sliced
from textguard.session import durable


# Accesses that one task sweeps in memory.
SLICE_ROWS = 1_000_000


def idle_epochs(accesses: DataFrame, conversation: str, ts: str, ttl_seconds: int) -> DataFrame:
    """``(conversation, _bucket, epoch, _n)``: which life of the conversation a time bucket falls in.

    Two accesses in one ttl-wide bucket are never more than ttl apart, so a life cannot end inside a
    bucket. Buckets collapse map-side; each conversation then has at most (time range / ttl) rows.
    """
    gap = ttl_seconds * 1_000_000
    buckets = (
        accesses.select(
            F.col(conversation),
            _bucket(accesses, ts, ttl_seconds).alias("_bucket"),
            micros(accesses, ts).alias("_at"),
        )
        .groupBy(conversation, "_bucket")
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    )
    by_time = Window.partitionBy(conversation).orderBy("_bucket")
    ended = (F.col("_first") - F.lag("_last").over(by_time) > gap).cast("bigint")
    return (
        buckets.withColumn("_ended", F.coalesce(ended, F.lit(0)))
        .withColumn("epoch", F.sum("_ended").over(by_time))
        .select(conversation, "_bucket", "epoch", "_n")
    )


def with_life(accesses: DataFrame, conversation: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Add ``life``: the start, in microseconds, of the life that an access is in. The same on a stream, see ``streaming.vault``."""
    starts = (
        accesses.select(conversation, micros(accesses, ts).alias("_at"), _bucket(accesses, ts, ttl_seconds).alias("_bucket"))
        .groupBy(conversation, "_bucket")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    epochs = idle_epochs(accesses, conversation, ts, ttl_seconds).drop("_n")
    in_life = Window.partitionBy(conversation, "epoch")
    lives = starts.join(epochs, [conversation, "_bucket"]).withColumn("life", F.min("_first").over(in_life)).drop("_first", "epoch")
    marked = accesses.withColumn("_bucket", _bucket(accesses, ts, ttl_seconds))
    return lookup_join(marked, lives, [conversation, "_bucket"], count="_n").drop("_bucket")


def life_ends(lives: DataFrame, conversation: str, ts: str, ttl_seconds: int) -> DataFrame:
    """``(conversation, epoch, expires_at)`` from accesses with their epoch: when the tokens of each life end."""
    return lives.groupBy(conversation, "epoch").agg(F.expr(f"max(`{ts}`) + INTERVAL '{ttl_seconds}' SECOND").alias("expires_at"))


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds of a time column; times without a zone do not depend on the session's zone."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{ts}`)")
    return F.unix_micros(F.col(ts))


def _as_time(df: DataFrame, ts: str, value: str) -> Column:
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"{_EPOCH} + make_dt_interval(0, 0, 0, `{value}` / 1000000BD)")
    return F.timestamp_micros(value)


def _bucket(df: DataFrame, ts: str, ttl_seconds: int) -> Column:
    return micros(df, ts) - F.pmod(micros(df, ts), F.lit(ttl_seconds * 1_000_000))


def with_idle_epoch(accesses: DataFrame, conversation: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Add ``epoch`` (0, 1, ...): a new one starts after more than ``ttl_seconds`` without access."""
    marked = accesses.withColumn("_bucket", _bucket(accesses, ts, ttl_seconds))
    epochs = idle_epochs(accesses, conversation, ts, ttl_seconds)
    return lookup_join(marked, epochs, [conversation, "_bucket"], count="_n").drop("_bucket")


def vault_accesses(
    accesses: DataFrame,
    conversation: str,
    ts: str,
    tie: str,
    ttl_seconds: int,
    max_conversations: int,
) -> DataFrame:
    """Add ``hit`` and ``epoch`` under both rules: least recently used conversations leave when more
    than ``max_conversations`` are live, idle ones when the time-out passes.

    The cap couples all conversations, so order matters globally. Time is cut into even slices. What
    an earlier slice passes on is small: its last ``max_conversations`` distinct conversations. With
    that, every slice is swept on its own.
    """
    rows = sliced(
        accesses.select(F.col(conversation).alias("c"), micros(accesses, ts).alias("t"), F.col(tie).alias("i")),
        [F.col("t"), F.col("i")],
        max_rows=SLICE_ROWS,
    )
    carried = _carried_in(rows, max_conversations)
    gap = ttl_seconds * 1_000_000
    kind = dict(rows.dtypes)
    shape = f"_slice int, c {kind['c']}, t bigint, i {kind['i']}, hit boolean, misses bigint"

    def sweep(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        live: OrderedDict = OrderedDict(
            zip(*[before.sort_values(["t", "i"])[k] for k in ("c", "t")]) if len(before) else ()
        )
        part = part.sort_values(["t", "i"])
        hits, counts, misses = [], [], {}
        for c, t in zip(part["c"], part["t"]):
            last = live.pop(c, None)
            hit = last is not None and t - last <= gap
            live[c] = t
            if len(live) > max_conversations:
                live.popitem(last=False)
            misses[c] = misses.get(c, 0) + (not hit)
            hits.append(hit)
            counts.append(misses[c])
        return part.assign(hit=hits, misses=counts)[["_slice", "c", "t", "i", "hit", "misses"]]

    swept = durable(
        rows.groupBy("_slice").cogroup(carried.groupBy("_slice")).applyInPandas(sweep, shape)
    )
    earlier = Window.partitionBy("c").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        swept.groupBy("_slice", "c")
        .agg(F.max("misses").alias("_n"))
        .select("_slice", "c", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return swept.join(offsets, ["_slice", "c"]).select(
        F.col("c").alias(conversation),
        _as_time(accesses, ts, "t").alias(ts),
        F.col("i").alias(tie),
        "hit",
        (F.col("misses") + F.col("_before") - 1).alias("epoch"),
    )


def _carried_in(rows: DataFrame, keep: int) -> DataFrame:
    """Per slice: the last ``keep`` distinct conversations of all earlier slices, with their last
    access. Doubles the reach each round until every slice has enough or reaches the first slice."""

    def latest(df: DataFrame) -> DataFrame:
        recent = Window.partitionBy("_slice").orderBy(F.desc("last"))
        return (
            df.groupBy("_slice", "c")
            .agg(F.max("last").alias("last"))
            .withColumn("_rn", F.row_number().over(recent))
            .where(F.col("_rn") <= keep)
            .drop("_rn")
        )

    tails = latest(rows.select("_slice", "c", F.struct("t", "i").alias("last")))
    slices = rows.agg(F.max("_slice")).first()[0] or 0
    state = durable(tails.withColumn("_slice", F.col("_slice") + 1).where(F.col("_slice") <= slices))
    reach = 1
    while reach < slices:
        short = (
            state.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).where(
                (F.col("n") < keep) & (F.col("_slice") > reach)
            )
        )
        if short.isEmpty() and state.select("_slice").distinct().count() >= slices:
            break
        further = state.withColumn("_slice", F.col("_slice") + reach).where(F.col("_slice") <= slices)
        state = durable(latest(state.unionByName(further)))
        reach *= 2
    return state.select("_slice", "c", F.col("last.t").alias("t"), F.col("last.i").alias("i"))
