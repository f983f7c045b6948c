"""Typed character spans found by patterns, all in built-in expressions.

Patterns are spelled so that java.util.regex runs them in linear time and without recursion
(possessive loops), with the same matches as the plain spelling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.arrays import scan
from textguard.functions.regex import match_spans

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Kind:
    """``guard`` is a cheaper test that every text with a match passes; ``keep`` drops failing matches."""

    name: str
    pattern: str
    guard: str
    keep: Callable[[Column], Column]


def kind_spans(text: str, kind: Kind, rank: int) -> Column:
    kept = F.filter(match_spans(text, kind.pattern, kind.guard), lambda s: kind.keep(s["value"]))
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            s["value"].alias("value"),
        ),
    ).cast(SPAN)


def all_spans(text: str, kinds: tuple[Kind, ...]) -> Column:
    """Spans of all kinds by start, then kind as listed."""
    return F.array_sort(F.concat(*[kind_spans(text, kind, k) for k, kind in enumerate(kinds)]))


def possible(text: str, kinds: tuple[Kind, ...]) -> Column:
    """False only for texts without any span: the guards alone."""
    any_guard = F.lit(False)
    for kind in kinds:
        any_guard = any_guard | F.col(text).rlike(kind.guard)
    return F.coalesce(any_guard, F.lit(False))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def replaced(text: Column, spans: Column, placeholder: Callable[[Column], Column]) -> Column:
    """Text with each span (sorted by start) replaced; of overlapping spans the first names the whole."""

    def step(stop: Column, span: Column) -> Column:
        gap = F.substring(text, stop + 1, span["start"] - stop)
        piece = F.when(span["start"] >= stop, F.concat(gap, placeholder(span))).otherwise(F.lit(""))
        return F.struct(F.greatest(stop, span["end"]).alias("state"), F.array(piece).alias("emit"))

    done = scan(spans, F.lit(0), step, "array<string>")
    return F.transform(
        F.array(done), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["state"] + 1, F.char_length(text)))
    )[0]
