"""Bitmaps of 64-bit hashes: broadcast hints, sized by the hashes' number and bounded by a parameter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 15  # bits of one aggregate


LEAST_BITS = 20


def bits_for(n: int, most: int) -> int:
    """log2 of a bitmap's size for n hashes: one bit in 64 is set at most, as long as `most` allows."""
    return min(most, max(LEAST_BITS, (64 * max(n, 1) - 1).bit_length()))


def bitmap(hashes: DataFrame, column: str, most: int) -> np.ndarray:
    """A bitmap (as bytes, lowest first) with the bit of every hash in the column set; hashes: a written table.

    It has 2**most bits at most: those bytes reach the driver. Beyond, more bits are set, and more candidates go on to the
    exact step. Blocks are native aggregates, combined before they are dealt.
    """
    bits = bits_for(hashes.count(), most)
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    built = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(BLOCK - 1))).alias("packed"))
    out, size = np.zeros(1 << bits >> 3, np.uint8), BLOCK >> 3
    for r in built.toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["packed"], np.uint8)
    return out


def member(bits_set: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    slots = hashes.astype(np.uint64) & np.uint64(len(bits_set) * 8 - 1)
    return (bits_set[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
