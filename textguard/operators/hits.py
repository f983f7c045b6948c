"""Findings of an outside detector, landed as a table of labelled spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.detect import FINDINGS_TYPE, finding
from textguard.policy import literal_map

# Outside label -> category; other labels are not used.
LABELS = {
    "private_person": "private_person",
    "private_address": "private_address",
    "private_email": "private_email",
    "private_phone": "private_phone",
    "private_url": "private_url",
    "private_date": "private_date",
    "account_number": "account_number",
    "secret": "secret",
}


# What an outside detector yields per text.
HITS_TYPE = "array<struct<label:string,start:int,end:int,score:double>>"


def category_of(label: Column) -> Column:
    return literal_map(LABELS)[label]


def hit_findings(hits: Column, text: Column) -> Column:
    """Complete hits with a known label and a non-empty span that starts inside the text, as findings. A span that goes on
    after the text ends with it: a detector that counts bytes or UTF-16 must not lose what it found."""
    length = F.char_length(text)

    def usable(h: Column) -> Column:
        sane = (h["start"] >= 0) & (h["start"] < h["end"]) & (h["start"] < length)
        return F.coalesce(category_of(h["label"]).isNotNull() & sane, F.lit(False))

    return F.coalesce(
        F.transform(
            F.filter(hits, usable),
            lambda h: finding(
                category_of(h["label"]),
                h["start"],
                F.least(h["end"], length),
                F.substr(text, h["start"] + 1, h["end"] - h["start"]),
                F.lit("privacy_filter"),
                F.lit("high"),
                confidence=F.coalesce(h["score"], F.lit(1.0)),
            ),
        ),
        F.array().cast(FINDINGS_TYPE),
    )


def usable_hits(hits: DataFrame, items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, category, start, end, score)`` of the hits that ``attach_hits`` turns into findings. Only lengths of texts are shuffled."""
    lengths = items.select(key, F.char_length(text).alias("_length"))
    known = (
        hits.where("label IS NOT NULL AND start >= 0 AND start < end")
        .select(key, category_of(F.col("label")).alias("category"), "start", "end", F.coalesce("score", F.lit(1.0)).alias("score"))
        .where("category IS NOT NULL")
    )
    inside = known.join(lengths, key).where("start < _length")
    return inside.select(key, "category", "start", F.least("end", "_length").alias("end"), "score")


def attach_hits(items: DataFrame, hits: DataFrame, key: str, text: str = "text", output: str = "hits") -> DataFrame:
    """Add ``output``: the landed hits of each text as findings. Exact repeats collapse first."""
    hit = F.struct("start", "end", "label", F.col("score").cast("double").alias("score"))
    per_item = (
        hits.where("start IS NOT NULL AND end IS NOT NULL")
        .where(F.col("label").isin(*LABELS))
        .select(key, hit.alias("hit"))
        .dropDuplicates()
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("hit")).alias("_hits"))
    )
    joined = items.join(per_item, key, "left")
    return joined.withColumn(output, hit_findings(F.col("_hits"), F.col(text))).drop("_hits")


def detect_hits(
    items: DataFrame, detector: Callable[[Column], Column], text: str = "text", output: str = "hits"
) -> DataFrame:
    """Add ``output`` from a detector that runs in the job: a pandas UDF from text to ``HITS_TYPE``."""
    found = items.withColumn("_hits", detector(F.col(text)).cast(HITS_TYPE))
    return found.withColumn(output, hit_findings(F.col("_hits"), F.col(text))).drop("_hits")
