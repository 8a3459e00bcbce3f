"""Hashes of byte runs by array operations, and bitmaps of hashed keys of a bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import materialize

#: Largest bitmap, as bits of a position: 2^27 bits are 16 MB.
MAX_BITS = 27


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHash:
    """Polynomial hashes modulo 2^64 of any runs of a byte array, by differences of prefix sums; base must be odd."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def _grow(self, n: int) -> None:
        if self.size < n:
            self.size = n + n // 4
            powers = []
            for b in (self.base, self.inverse):
                p = np.full(self.size, b, np.uint64)
                p[0] = 1
                powers.append(np.cumprod(p, dtype=np.uint64))
            self.up, self.down = powers

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte array, for runs()."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k bytes at each place that has as many."""
        return mix((sums[k:] - sums[:-k]) * self.down[: len(sums) - k] + np.uint64(k))


def bitmap_of(keys: DataFrame, column: str, name: str, max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """A bitmap of the 64-bit keys by their upper bits, about 16 bits a key but at most 2^max_bits, and the number of bits of a position. Only the bitmap's words reach the driver."""
    found = materialize(keys.select(column), name)
    bits = min(max_bits, max(16, (16 * found.count()).bit_length()))
    at = found.select(F.shiftrightunsigned(column, 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return bitmap, bits


def in_bitmap(keys: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = keys >> np.uint64(64 - bits)
    return ((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
