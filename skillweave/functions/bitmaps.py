"""A bitmap of fixed size as a filter in front of a join: what it lacks needs no join, what it holds is joined."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of 2**bits bits with bit (column mod 2**bits) set for each row's long. Built by a distributed
    aggregation; what reaches the driver is at most 2**bits / 8 bytes, however many rows there are."""
    slot = F.expr(f"({column} & {(1 << bits) - 1}L) + 1")
    parts = (df.select(slot.alias("slot"))
             .groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect())
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for bucket, part in parts:
        at = (bucket - 1) * 4096
        part = np.frombuffer(bytes(part), dtype=np.uint8)[:max(0, len(out) - at)]
        out[at:at + len(part)] = part
    return out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the uint64 values have their bit set; no false negatives."""
    slot = values & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
