"""Array building blocks on top of Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Catalyst may inline a projected column into a lambda, where it would run once per element; a
    lambda variable is evaluated once per row.
    """
    return F.transform(F.array(value), body).getItem(0)


def computed_once(value: Column) -> Column:
    """Keep an expensive column from being copied into later filters and projections.

    Catalyst moves a filter below the projection it reads from by inlining the column, so a test on a
    detector's result would run the detector a second time. It leaves non-deterministic columns where
    they are; this one is always true. (Filter on plain columns before, not after, such a column.)
    """
    return F.when(F.spark_partition_id() >= 0, value)


def scan(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    emits: str,
) -> Column:
    """Left-to-right fold that emits elements: ``step(state, item) -> struct(state, emit array)``.

    Returns ``struct(state, out)`` where ``out`` (SQL type ``emits``) holds everything emitted in
    order. Spark arrays are immutable, so appending to one long accumulator costs O(n^2); folding in
    chunks keeps the copied part short.
    """
    empty = F.array().cast(emits)

    def chunk(all_items: Column, outer: Column, index: Column) -> Column:
        inner = F.aggregate(
            F.slice(all_items, index * CHUNK + 1, CHUNK),
            F.struct(outer["state"].alias("state"), empty.alias("out")),
            lambda acc, item: bind(
                step(acc["state"], item),
                lambda done: F.struct(
                    done["state"].alias("state"),
                    F.concat(acc["out"], done["emit"]).alias("out"),
                ),
            ),
        )
        return bind(
            inner,
            lambda done: F.struct(
                done["state"].alias("state"), F.concat(outer["out"], done["out"]).alias("out")
            ),
        )

    def run(all_items: Column) -> Column:
        last = F.floor((F.size(all_items) - 1) / CHUNK).cast("int")
        return F.aggregate(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            F.struct(zero.alias("state"), empty.alias("out")),
            lambda outer, index: chunk(all_items, outer, index),
        )

    return bind(items, run)
