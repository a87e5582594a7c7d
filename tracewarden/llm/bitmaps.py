"""Bitmaps of hashed values: a filter of a fixed size that every executor can hold.

A value whose bit is not set is not in the set; one whose bit is set may be. With more
values the filter lets more through, and never loses one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spark's bitmaps have 32768 positions, numbered from 1 in bucket 1, the low bit of a byte first.
_POSITIONS = 32_768


def bitmap_of(values: DataFrame, bits: int) -> bytes:
    """2 ** bits bits: those are set that the leading ``bits`` bits of a hash in column ``value`` name."""
    place = F.shiftrightunsigned("value", 64 - bits) + 1
    parts = (
        values.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("map"))
        .collect()
    )
    size = _POSITIONS // 8
    whole = np.zeros(max(size, (1 << bits) // 8), np.uint8)
    for part in parts:
        at = (part["bucket"] - 1) * size
        whole[at : at + size] = np.frombuffer(bytes(part["map"]), np.uint8)
    return whole.tobytes()


def bit_places(values: np.ndarray, bits: int) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def has_bit(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places // 8] >> (places % 8).astype(np.uint8)) & 1 > 0
