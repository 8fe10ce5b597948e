"""A Bloom filter of 64-bit keys whose size is bounded, made by a grouped aggregation.

A key sets four bits of one 64-bit slot. The filter has no false negatives; where the keys outgrow the
largest size, more keys pass that are not in it, and what follows must be exact without it.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Bits for a key, and the most slots: 32 MB.
BITS, SLOTS = 16, 1 << 22


def build(keys: DataFrame, count: int, slots: int | None = None) -> Broadcast:
    """The filter of the ``count`` values of ``keys(key long)``, sent to all workers."""
    slots = slots or int(min(SLOTS, max(64, count * BITS // 64)))
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned("key", 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    slot = F.pmod(F.shiftrightunsigned("key", 24), F.lit(slots)).cast("int").alias("slot")
    found = keys.select(slot, mask.alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(slots, np.uint64)
    words[found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def test(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may be in the filter."""
    keys = keys.view(np.uint64)
    one, low = np.uint64(1), np.uint64(63)
    mask = one << (keys & low)
    for k in range(1, 4):
        mask |= one << (keys >> np.uint64(6 * k) & low)
    return words[(keys >> np.uint64(24)) % np.uint64(len(words))] & mask == mask
