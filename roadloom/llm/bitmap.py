"""A set of 64-bit keys as a bitmap: may have keys that aren't in it, misses none.

It decides only what is passed on to an exact step, so a fuller bitmap costs time, never results. Its size
follows the plan's estimate of the input, between 8 MB and 128 MB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap for small or unknown inputs (8 MB), and of the largest one (128 MB).
BITS, MOST_BITS = 1 << 26, 1 << 30


class Bitmap:
    def __init__(self, body, broadcast=None, bits: int = BITS, empty: bool = False):
        self.broadcast, self._body, self.bits, self.empty = broadcast, body, bits, empty

    def __getstate__(self):
        return {"broadcast": self.broadcast, "_body": None, "bits": self.bits, "empty": self.empty}

    @property
    def body(self) -> np.ndarray:
        if self._body is None:
            self._body = np.frombuffer(self.broadcast.value, np.uint8)
        return self._body

    def has(self, key: int) -> bool:
        bit = key % self.bits
        return bool(self.body[bit >> 3] >> (bit & 7) & 1)

    def has_all(self, keys: np.ndarray) -> np.ndarray:
        bit = keys.astype(np.int64) & (self.bits - 1)
        return (self.body[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def bits_for(df: DataFrame) -> int:
    """Bits for keys of `df`'s rows, by the optimizer's estimate of its bytes: about one for 20 bytes of files,
    which leaves a bitmap of repeated keys a tenth full; an unknown size counts as small."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return BITS if size >= 1 << 60 else max(BITS, min(MOST_BITS, 1 << (size // 20).bit_length()))


def collect_bitmap(keys: DataFrame, bits: int = BITS) -> Bitmap:
    """Of the column `key` (long). The driver receives at most one row for each 32,768 bits."""
    at = keys.select(F.pmod("key", F.lit(bits)).alias("b")).select((F.shiftright("b", 15)).alias("k"), F.expr("b % 32768").alias("b"))
    maps = at.groupBy("k").agg(F.expr("bitmap_construct_agg(b)").alias("bits")).collect()
    out = bytearray(bits // 8)
    for r in maps:
        out[r["k"] * 4096 : r["k"] * 4096 + len(r["bits"])] = r["bits"]
    return Bitmap(None, keys.sparkSession.sparkContext.broadcast(bytes(out)), bits, not maps)
