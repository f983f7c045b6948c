"""Joins, numbering and running totals that hold up when a few keys own most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.session import durable

# A key is hot when it owns more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot
# keys whatever the data: that bounds what is broadcast.
HOT_SHARE = 1000


def lookup_join(facts: DataFrame, table: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """Left join to a table with unique keys, with hot keys kept out of the shuffle.

    Hot keys get their (at most ``HOT_SHARE``) table rows by broadcast. In the shuffle join that
    serves all other keys, rows already served are spread by their content, not by their key.
    ``count`` names a table column with the number of facts per key, if the table was made from the
    facts. Without it, ``facts`` is read a second time to count; pass stored data if it is costly.
    """
    values = [c for c in table.columns if c not in keys and c != count]
    if count:
        per_key = table.select(*keys, F.col(count).alias("_n"))
    else:
        per_key = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = per_key.agg(F.sum("_n")).scalar()
    hot_keys = per_key.where(F.col("_n") * HOT_SHARE > total).select(*keys)
    hot = table.join(F.broadcast(hot_keys), keys, "left_semi").select(
        *keys, F.struct(*values).alias("_hot")
    )
    served = facts.join(F.broadcast(hot), keys, "left")
    row = F.xxhash64(*[F.col(c).cast("string") for c in facts.columns])
    spread = F.when(F.col("_hot").isNotNull(), row)
    cold = table.select(*keys, F.struct(*values).alias("_cold"), F.lit(None).cast("bigint").alias("_spread"))
    joined = served.withColumn("_spread", spread).alias("f").join(
        cold.alias("t"),
        [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        + [F.col("f._spread").eqNullSafe(F.col("t._spread"))],
        "left",
    )
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(
        *[F.col(f"f.{c}").alias(c) for c in facts.columns], *[got[v].alias(v) for v in values]
    )


def sliced(df: DataFrame, order: list[Column], name: str = "_slice", max_rows: int | None = None) -> DataFrame:
    """Cut the whole table into even, ordered slices and pin each row's slice number.

    Slices follow the order across all keys, so their size does not depend on any key's share. The
    checkpoint fixes the numbers: later jobs and retries see the same slices. ``max_rows`` bounds the
    (average) slice for steps that hold one in memory; it costs a count.
    """
    if max_rows is None:
        ranged = df.repartitionByRange(*order)
    else:
        enough = -(-df.count() // max_rows)
        ranged = df.repartitionByRange(max(enough, df.sparkSession.sparkContext.defaultParallelism), *order)
    return durable(ranged.withColumn(name, F.spark_partition_id()))


def number_within(df: DataFrame, group: list[str], order: list[str], output: str) -> DataFrame:
    """``row_number`` per group without giving a whole group to one task.

    ``group + order`` must be unique. Rows are numbered within (slice, group), then shifted by the
    group's count in earlier slices.
    """
    parts = sliced(df, [F.col(c) for c in group + order])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_slice", *group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy("_slice", *group).orderBy(*order))
    return (
        parts.withColumn("_local", local)
        .join(offsets, ["_slice", *group])
        .withColumn(output, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_local", "_before")
    )
