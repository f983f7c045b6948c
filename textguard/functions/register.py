"""Names for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textguard.operators.extract import leaves_below, write_back
from textguard.operators.normalize import obfuscated_spans


def register(spark: SparkSession) -> list[str]:
    """Register the Arrow UDFs for use in ``spark.sql``; returns their names."""
    functions = {
        "obfuscated_spans": obfuscated_spans,
        "json_leaves": leaves_below,
        "json_write_back": write_back,
    }
    for name, function in functions.items():
        spark.udf.register(name, function)
    return list(functions)
