"""Fixed-size filters of 64-bit hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = (16, 28)  # bounds for the powers of two of the fixed-size filters
TURNS = (0, 17, 31, 47)  # rotations of a hash that give its places in a filter


class BitFilter:
    """A set of hashes as a Bloom filter of bounded size; it may say yes too often, never no."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for turn in TURNS:
            at = ((hashes << np.uint64(turn)) | (hashes >> np.uint64(63 - turn) >> np.uint64(1))) >> np.uint64(64 - self.bits)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bit_filter(hashes: DataFrame, column: str) -> BitFilter:
    """Filter over a hash column; at most 2**FILTER_BITS[1] bits (32 MB) come to the driver, whatever the data."""
    rows = hashes.count()
    bits = min(max(FILTER_BITS[0], (32 * max(rows, 1)).bit_length()), FILTER_BITS[1])
    turned = [F.shiftleft(column, t).bitwiseOR(F.shiftrightunsigned(F.shiftrightunsigned(column, 63 - t), 1)) for t in TURNS]
    at = hashes.select(F.explode(F.array(*[F.shiftrightunsigned(t, 64 - bits) for t in turned])).alias("at"))
    one = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    got = at.groupBy(F.shiftrightunsigned("at", 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return BitFilter(bits, words)
