"""Checks that outputs are clean, as data jobs. Each returns violations; empty means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.arrays import bind
from textguard.functions.literals import containing
from textguard.operators.tokens import ANY_TOKEN

# Needles up to this many characters in all are sent to every task; more are joined by shuffle.
BROADCAST_CHARS = 8_000_000
_GRAM = 4


def leaks(bodies: DataFrame, needles: DataFrame, key: str, body: str = "body") -> DataFrame:
    """``(key, name)``: outputs that contain a needle as a fixed string; the value is not reported.

    Needles of a checked size are looked for by automata, without a shuffle. More of them meet the texts in an equi-join on a
    mark that any text with the needle has: of the needle's pieces of four characters the one that fewest needles share. The
    full needle is checked on the pairs that meet.
    """
    named = needles.where(F.coalesce(F.col("value"), F.lit("")) != "").select("name", "value")
    size = named.agg(F.coalesce(F.sum(F.char_length("value")), F.lit(0))).first()[0]
    if size > BROADCAST_CHARS:
        return _meeting(bodies, named, key, body).distinct()
    rows = named.distinct().collect()
    names = bodies.sparkSession.createDataFrame([(k, r.name) for k, r in enumerate(rows)], "_number bigint, name string")
    strings = [(k, r.value) for k, r in enumerate(rows)]
    found = containing(bodies.select(key, body), body, strings, "_number")
    return found.select(key, "_number").join(F.broadcast(names), "_number").select(key, "name").distinct()


def _pieces(text: Column, shortest: int) -> Column:
    """All pieces of ``shortest`` to four characters."""

    def of_length(chars: Column, n: int) -> Column:
        enough = F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        return F.transform(enough, lambda _, i: F.array_join(F.slice(chars, i + 1, n), ""))

    return bind(
        F.split(text, ""),
        lambda chars: F.flatten(F.array(*[of_length(chars, n) for n in range(shortest, _GRAM + 1)])),
    )


def _meeting(bodies: DataFrame, needles: DataFrame, key: str, body: str) -> DataFrame:
    # A shorter needle is its own mark.
    whole = F.char_length("value") < _GRAM
    marks = F.when(whole, F.array("value")).otherwise(F.array_distinct(_pieces(F.col("value"), _GRAM)))
    pieces = needles.select("name", "value", F.explode(marks).alias("mark"))
    sharing = pieces.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(sharing, "mark").groupBy("name", "value").agg(F.min_by("mark", F.struct("n", "mark")).alias("mark"))
    each = F.explode(F.array_distinct(_pieces(F.coalesce(F.col(body), F.lit("")), 1))).alias("mark")
    pairs = bodies.select(key, each).join(rarest, "mark").select(key, "name", "value").distinct()
    return pairs.join(bodies.select(key, body), key).where(F.contains(F.col(body), F.col("value"))).select(key, "name")


def replay_failures(results: DataFrame, expectations: DataFrame, key: str) -> DataFrame:
    """``(key, problem)`` where a decision or an output differs from what a fixture expects.

    ``results``: key, allowed, body. ``expectations``: key, expect_allowed, must_contain,
    must_not_contain.
    """
    joined = expectations.join(results, key, "left")
    text = F.coalesce("body", F.lit(""))
    problems = F.array(
        F.when(~F.col("allowed").eqNullSafe(F.col("expect_allowed")), F.lit("decision")),
        F.when(F.exists("must_not_contain", lambda s: F.contains(text, s)), F.lit("forbidden text")),
        F.when(~F.forall("must_contain", lambda s: F.contains(text, s)), F.lit("missing text")),
    )
    return joined.select(key, F.explode(F.array_compact(problems)).alias("problem"))


def has_placeholder(text: Column) -> Column:
    return F.rlike(text, F.lit(ANY_TOKEN))


def escaped_requests(blocked: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Blocked requests that nevertheless have an output row."""
    return blocked.select(key).distinct().join(sent.select(key), key, "left_semi")


def changed_without_finding(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Allowed texts that changed although nothing was found in them."""
    return items.where(F.col("allowed") & (F.size("resolved") == 0) & (F.col("redacted") != F.col(text))).select(key)
