"""Shared pieces of the training-data operators: query registry, inputs, text helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.session import scratch_folder, ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return run(spark, folder)

        QUERIES[name] = shipped
        if sql is not None:
            CHECK_SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


class Scratch:
    """Tables in the shared folder that cut lineage; what is no longer needed can be removed before the job ends."""

    def __init__(self, name: str):
        self.name = name
        self.tables: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """Write a table, in folders by the last columns if these are named."""
        path = scratch_folder(df.sparkSession, f"{self.name}-{name}")
        df.write.partitionBy(*folders).parquet(path)
        stored = df.sparkSession.read.schema(df.schema).parquet(path)
        self.tables.append((stored, path))
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Remove the files of tables that no later step reads."""
        for df in tables:
            path = next(p for known, p in self.tables if known is df)
            self.tables = [(known, p) for known, p in self.tables if known is not df]
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# What the word contracts call white space: space and \t to \r, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words between spaces and \\t to \\r; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def row_key(*columns: str) -> Column:
    """Long that tells rows apart by content; nulls count as values."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c), F.col(c).isNull())])


def chunks(items: Iterator, size: int) -> Iterator[list]:
    while part := list(islice(items, size)):
        yield part
