"""Conversation lives on a stream, in event time.

A life is a stretch of accesses with no pause longer than the time-out; its name is the time it starts at. Accesses may
arrive in any order within the stream's watermark delay: they wait in state until the watermark has
passed them, so the lives do not depend on how the stream was cut into batches. What arrives later than that is
marked ``late`` and gets no life. State holds waiting accesses and two times per live conversation; both go
when the watermark passes them, the times a time-out after the last access.

Every call to the state store goes over a socket, so a conversation makes few of them in a batch: waiting accesses are kept in
chunks with a list per column, and a conversation has one timer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textguard.operators.vault import micros
from textguard.policy import Policy


CHUNK_ROWS = 1000


class EventTimeLives(StatefulProcessor):
    """Per conversation: accesses that wait (``at`` and what they carry), and start and last access of the current life."""

    def __init__(self, ttl_seconds: int, carried: list[tuple[str, str]]) -> None:
        self.ttl = ttl_seconds * 1_000_000
        self.names = [name for name, _ in carried]
        self.waiting_type = ", ".join(["at array<bigint>", *(f"`{name}` array<{kind}>" for name, kind in carried)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_type)
        self.life = handle.getValueState("life", "start bigint, last bigint")
        self.access = Row("conversation", "at", *self.names, "life", "late")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = _micros_of(timerValues)
        chunk: list[tuple] = []
        first = None
        for row in rows:
            access = (row["at"], *(row[name] for name in self.names))
            if access[0] < now:
                yield self.access(key[0], *access, None, True)
                continue
            first = access[0] if first is None else min(first, access[0])
            chunk.append(access)
            if len(chunk) == CHUNK_ROWS:
                self.waiting.appendValue(_columns(chunk))
                chunk = []
        if chunk:
            self.waiting.appendValue(_columns(chunk))
        if first is not None:
            due = first // 1000 + 1
            timers = list(self.handle.listTimers())
            # The timer for the end of a life, or for a later access, gives way: it comes again after this one.
            if not timers or due < min(timers):
                for old in timers:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = _micros_of(timerValues)
        waiting = sorted((access for chunk in self.waiting.get() for access in zip(*chunk)), key=lambda access: access[0])
        done = bisect_left(waiting, now, key=lambda access: access[0])
        known = self.life.get()
        start, last = known or (None, None)
        for access in waiting[:done]:
            if last is None or access[0] - last > self.ttl:
                start = access[0]
            last = access[0]
            yield self.access(key[0], *access, start, False)
        rest = waiting[done:]
        if done and rest:
            self.waiting.put([_columns(rest[k : k + CHUNK_ROWS]) for k in range(0, len(rest), CHUNK_ROWS)])
        elif done:
            self.waiting.clear()
        ended = last is not None and last + self.ttl < now
        if ended and known:
            self.life.clear()
        elif last is not None and not ended and (start, last) != known:
            self.life.update((start, last))
        # One timer: for the first access that waits, else for the end of the life.
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif last is not None and not ended:
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)

    def close(self) -> None:
        pass


def _columns(accesses: list[tuple]) -> tuple:
    return tuple(list(column) for column in zip(*accesses))


def _micros_of(timerValues) -> int:
    return timerValues.getCurrentWatermarkInMs() * 1000


def life_stream(stream: DataFrame, conversation: str, ts: str, ttl_seconds: int, delay: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(conversation, at, *carry, life, late)`` for every access of a stream, once the watermark has passed it.

    ``delay`` is how late an access may arrive, as an interval. ``at`` and ``life`` are microseconds. Rows without
    conversation or time are left out. Needs the RocksDB state store.
    """
    kinds = dict(stream.dtypes)
    plain = stream.select(F.col(conversation).cast("string").alias("conversation"), micros(stream, ts).alias("at"), *carry)
    # A watermark needs a time with a zone; without that column after it, no row is dropped as late before it is seen here.
    timed = plain.where("conversation IS NOT NULL AND at IS NOT NULL").withColumn("_time", F.timestamp_micros("at"))
    rows = timed.withWatermark("_time", delay).drop("_time")
    carried = [(name, kinds[name]) for name in carry]
    columns = ["conversation string", "at bigint", *(f"`{n}` {k}" for n, k in carried), "life bigint", "late boolean"]
    return rows.groupBy("conversation").transformWithState(
        statefulProcessor=EventTimeLives(ttl_seconds, carried),
        outputStructType=", ".join(columns),
        outputMode="append",
        timeMode="EventTime",
    )


def redact_life_stream(
    stream: DataFrame, policy: Policy, conversation: str, ts: str, delay: str, key: str | None = None, text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Redact a stream of timed texts; tokens belong to a life of their conversation (time-out: the policy's ``ttl_seconds``).

    Late texts are redacted too, each in a life of its own, so that nothing is lost or tied to a life that has ended.
    """
    from textguard.plans.redact import redact_texts

    lives = life_stream(stream, conversation, ts, policy.tokenization.ttl_seconds, delay, (text, *carry))
    return redact_texts(lives, policy, F.col("conversation"), key, text, epoch=own_life())


def own_life() -> Column:
    """The life a token belongs to; a late text is one by itself."""
    return F.coalesce(F.col("life").cast("string"), F.concat(F.lit("late:"), F.col("at").cast("string")))
