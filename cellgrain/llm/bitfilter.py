"""Bitmaps that tell tasks which 64-bit hashes may matter: never a miss, some false hits, a bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrain.llm.wordhash import U

#: The largest bitmap has 2**MAX_BITS bits (128 MB). Beyond what it can tell apart it lets more hashes through, no fewer.
MIN_BITS, MAX_BITS = 18, 30
_PART = 4096  # bytes of one of Spark's bitmaps


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of the only column of ``hashes`` (distinct numbers): 16 bits a hash, MAX_BITS at most.

    Spark sets the bits; what reaches the driver is the bitmap, in parts.
    """
    hashes = hashes.toDF("h")
    bits = min(max((16 * hashes.count()).bit_length(), MIN_BITS), MAX_BITS)
    place = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - bits)).alias("p")
    parts = hashes.select(place).groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("held")
    )
    out = np.zeros(2**bits // 8, dtype=np.uint8)
    for part, held in parts.collect():
        out[(part - 1) * _PART : (part - 1) * _PART + len(held)] |= np.frombuffer(held, dtype=np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those the bitmap was made of."""
    at = hashes >> U(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
