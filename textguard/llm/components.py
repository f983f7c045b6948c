"""Connected components of a graph of long keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import Scratch

FEW_EDGES = 1 << 20  # graphs of so many edges (16 MB) are solved at once


def joined(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smallest place joined to each of n places by edges x - y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, label):
            return label
        label = new


def _solved(edges: DataFrame) -> DataFrame:
    """``key, root`` of a graph of few edges."""
    got = edges.toArrow()
    ends = [got.column(c).to_numpy() for c in ("a", "b")]
    keys, place = np.unique(np.concatenate(ends), return_inverse=True)
    x, y = np.split(place, 2)
    return edges.sparkSession.createDataFrame(pa.table({"key": keys, "root": keys[joined(x, y, len(keys))]}))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, component`` (the smallest key reached) of every key with an edge ``a, b``.

    While a graph has many edges, each key moves to the first of its neighbours and itself in an order drawn anew in every round, and edges move
    with their ends. That keeps what is connected, and the keys left are a constant share less from round to round, however long the paths
    are. What is left is solved at once; the moves are then followed back. Edges of earlier rounds are removed.
    """
    graph = scratch.store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while graph.count() > FEW_EDGES:
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64("b", F.lit(len(moves))).alias("draw"), F.col("b").alias("key"))).alias("near")
        own = F.struct(F.xxhash64("a", F.lit(len(moves))).alias("draw"), F.col("a").alias("key"))
        to = both.groupBy("a").agg(first).select(F.col("a").alias("key"), F.least("near", own)["key"].alias("root"))
        moves.append(scratch.store(to, "moves"))
        moved = graph.join(moves[-1].select(F.col("key").alias("a"), F.col("root").alias("ra")), "a")
        moved = moved.join(moves[-1].select(F.col("key").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        after = scratch.store(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        scratch.drop(graph)
        graph = after
    roots = scratch.store(_solved(graph), "roots")
    scratch.drop(graph)
    for step in reversed(moves):
        known = roots.select(F.col("key").alias("root"), F.col("root").alias("last"))
        further = scratch.store(step.join(known, "root", "left").select("key", F.coalesce("last", "root").alias("root")), "roots")
        scratch.drop(roots, step)
        roots = further
    least = roots.groupBy("root").agg(F.min("key").alias("component"))
    named = scratch.store(roots.join(least, "root").select("key", "component"), "components")
    scratch.drop(roots)
    return named
