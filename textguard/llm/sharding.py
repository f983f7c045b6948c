"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash. Pass two shuffles each
bucket (Fisher-Yates) in memory. Buckets in order give one random permutation of the table; equal
stretches of it are the shards, so their row counts differ by one at most (law ``rows``).

Rows that are equal in every column are first counted as one and dealt out again by their number, so a record
that makes up much of the table does not fill one bucket. The permutation of
a bucket depends on the seed and on the task layout; buckets and shard sizes depend on the seed and the data only.

Defined results: null texts have size 1; null ids are scattered like others; an empty table gives no
rows. Fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textguard.llm.common import query, row_key, table
from textguard.session import scratch_folder

SHARDS = 8
# A task holds some copies of a bucket (gathered, sorted, shuffled) while shards are written.
BUCKET_BYTES = 16 << 20
GROUP = 1024


def _starts(per_bucket: DataFrame) -> DataFrame:
    """``_bucket, _before``: rows in earlier buckets, summed in two levels so that no task has them all."""
    grouped = per_bucket.withColumn("_group", (F.col("_bucket") / GROUP).cast("bigint"))
    totals = grouped.groupBy("_group").agg(F.sum("_n").alias("_n_group"))
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_group", F.coalesce(F.sum("_n_group").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return within.join(totals, "_group").select("_bucket", (F.col("_from") + F.col("_inside")).alias("_before"))


def two_pass_shuffle(
    records: DataFrame,
    size: Column,
    shards: int = SHARDS,
    seed: int = 1,
    bucket_bytes: int = BUCKET_BYTES,
    unique: bool = False,
) -> DataFrame:
    """Records with ``shard`` and ``slot``. ``size`` is a record's bytes, which sets the number of buckets.

    ``unique`` says that no two rows are equal, which saves the counting of equal rows.
    """
    columns = records.columns
    plain = records.toDF(*[f"_c{k}" for k in range(len(columns))])
    names = plain.columns
    totals = records.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    n, buckets = totals["n"], max(1, -(-(totals["bytes"] or 0) // bucket_bytes))
    if unique:
        keyed = plain.withColumn("_copy", F.lit(0))
    else:
        keyed = plain.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    spot = F.xxhash64(F.lit(seed), row_key(*names), "_copy")
    scattered = keyed.withColumn("_spot", spot).withColumn("_bucket", F.pmod("_spot", F.lit(buckets)))
    starts = _starts(scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))
    gathered = scattered.groupBy("_bucket").agg(F.collect_list(F.struct("_spot", *names)).alias("_rows"))
    shuffled = gathered.select("_bucket", F.posexplode(F.shuffle(F.sort_array("_rows"), F.lit(seed))).alias("_at", "_row"))
    place = (F.col("_before") + F.col("_at")).cast("bigint")
    placed = shuffled.join(starts, "_bucket").withColumn("_place", place)
    shard = F.expr(f"CAST((_place * {shards}) DIV {max(n, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards} - 1) DIV {shards}")
    numbered = placed.withColumn("shard", shard).withColumn("slot", F.col("_place") - first)
    return numbered.select(*[F.col(f"_row.{c}").alias(o) for c, o in zip(names, columns, strict=True)], "shard", "slot")


def write_shards(records: DataFrame, size: Column, path: str, **options) -> DataFrame:
    """Write whole records as Parquet, a folder per shard, each file a stretch of slots; returns what was written."""
    placed = two_pass_shuffle(records, size, **options)
    placed.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return records.sparkSession.read.schema(placed.schema).parquet(path)


@query("op4_two_pass_shuffle")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of whole documents, written to the shared folder; sizes and digests are of the texts written."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("bigint")
    written = write_shards(table(spark, folder, "documents", "doc_id", "text"), size, scratch_folder(spark, "shards"))
    crc32 = F.crc32(text.cast("binary")).cast("bigint")
    return written.select(
        "doc_id", size.alias("size"), crc32.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
