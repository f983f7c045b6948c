"""Inputs: request payloads, text tables, rules, outside hits, capture logs."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators.rules import PACK_SCHEMA, RULE_FIELDS, RULE_SCHEMA
from textguard.policy import Policy

CAPTURE_SCHEMA = "method string, url string, headers map<string,string>, body string"
HIT_TYPE = "array<struct<label:string,start:int,end:int,score:double>>"
# Headers that carry credentials.
SECRET_HEADERS = ("authorization", "x-api-key")


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``(request_id, payload, source_file)``: one JSON request per line, or per file. The id is made
    of the place and the content, so re-runs agree."""
    lines = spark.read.text(path, wholetext=whole_files)
    return _with_id(lines)


def stream_payloads(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The same as a stream over a directory that requests land in."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return _with_id(lines)


def _with_id(lines: DataFrame) -> DataFrame:
    source = F.col("_metadata.file_path")
    at = F.concat_ws(":", source, F.col("_metadata.file_block_start").cast("string"), "value")
    return lines.select(
        F.sha2(at, 256).alias("request_id"), F.col("value").alias("payload"), source.alias("source_file")
    ).where(F.trim("payload") != "")


def read_texts(spark: SparkSession, path: str, key: str, text: str) -> DataFrame:
    """``(key, text)`` of a parquet table; only these columns are scanned."""
    return spread(spark.read.parquet(path).select(F.col(key), F.col(text).alias("text")), key)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Shuffle a scan to ``spark.textguard.scan.partitions`` partitions if the session sets that (for small tables in few
    row groups); otherwise the file splits stay. The size of the data plays no part."""
    wanted = scan.sparkSession.conf.get("spark.textguard.scan.partitions", None)
    return scan if scan.isStreaming or wanted is None else scan.repartition(int(wanted), key)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Replay cases, one JSON document per file, in file order."""
    schema = (
        "name string, payload variant, expect_allowed boolean, "
        "must_not_contain array<string>, must_contain array<string>"
    )
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select("*", F.col("_metadata.file_path").alias("source_file"))
        .withColumn("payload", F.to_json("payload"))
    )


def read_policy_rules(path: str) -> list[dict]:
    """Rules of one policy file."""
    return Policy.from_yaml(path).rules


def read_rule_packs(spark: SparkSession, folder: str | Path) -> DataFrame:
    """Rule packs of a folder of YAML files, by file name (configuration: read on the driver)."""
    rows = []
    for path in sorted(Path(folder).glob("*.yaml")):
        pack = yaml.safe_load(path.read_text("utf-8")) or {}
        rows.append(
            {
                "rules": [_full(r) for r in pack.get("rules", [])],
                "keywords": [str(k) for k in pack.get("keywords", [])],
                "custom_regex": [_full(r) for r in pack.get("custom_regex", [])],
            }
        )
    return spark.createDataFrame(rows, PACK_SCHEMA)


def _full(rule: dict) -> dict:
    return {name: rule.get(name) for name in RULE_FIELDS}


def read_rule_feed(spark: SparkSession, path: str) -> DataFrame:
    """Rules landed as ``{"rules": [...]}`` documents; a document without rules adds none."""
    return spark.read.schema(f"rules array<{RULE_SCHEMA}>").json(path).select(F.inline("rules"))


def hits_from_json(response: Column) -> Column:
    """Outside hits from either response shape, ``{"findings": [...]}`` or a bare list."""
    wrapped = F.from_json(response, f"struct<findings:{HIT_TYPE}>")["findings"]
    bare = F.from_json(response, HIT_TYPE)
    return F.when(F.rlike(response, F.lit(r"^\s*+\[")), bare).otherwise(wrapped)


def read_hits(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``(key, label, start, end, score)`` from landed detector responses: lines with the text's key
    and the raw ``response``."""
    landed = spark.read.schema(f"{key} string, response string").json(path)
    return landed.select(key, F.inline(hits_from_json(F.col("response"))))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captured requests, one JSON event per line, with credentials masked."""
    return mask_headers(spark.read.schema(CAPTURE_SCHEMA).json(path))


def is_secret_header(name: Column) -> Column:
    return F.lower(name).isin(*SECRET_HEADERS)


def mask_headers(captures: DataFrame, headers: str = "headers", keep_others: bool = True) -> DataFrame:
    masked = F.transform_values(
        headers, lambda k, v: F.when(is_secret_header(k), F.lit("[redacted]")).otherwise(v)
    )
    if not keep_others:
        masked = F.map_filter(masked, lambda k, v: is_secret_header(k))
    return captures.withColumn(headers, masked)
