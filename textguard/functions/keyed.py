"""Keyed hashing in SQL: HMAC-SHA256 from built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """The two HMAC key pads (RFC 2104); the key itself does not enter the plan."""
    raw = key.encode("utf-8")
    if len(raw) > _BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def framed(*parts: Column) -> Column:
    """Join strings unambiguously: every part is preceded by its length."""
    pieces = []
    for part in parts:
        pieces += [F.char_length(part).cast("string"), F.lit(":"), part]
    return F.concat(*pieces)


def with_key(df: DataFrame, key: str, output: str = "_key") -> DataFrame:
    """Add the key pads as a column. They come from a one-row table through a scalar subquery: a
    literal would show up in query plans, and with them in the event log."""
    inner, outer = hmac_pads(key)
    pads = df.sparkSession.createDataFrame([((inner, outer),)], "pads struct<inner:binary,outer:binary>")
    return df.withColumn(output, pads.scalar())


def hmac_sha256(pads: Column, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column, with the pads column of ``with_key``."""
    inner = F.sha2(F.concat(pads["inner"], F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(pads["outer"], F.unhex(inner)), 256)
