"""A set of hashes as a bitmap of bounded size, gathered by a grouped OR."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._staging import shuffles_removed


@dataclass(frozen=True)
class Bitmap:
    """A set of hashes in which others may seem to be, never the other way round: one bit each of a power of two."""

    bits: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    def __reduce__(self):
        # compressed on its way: the driver and each executor keep what was sent on their disks
        return _unpacked, (len(self.bits), pa.compress(self.bits.tobytes(), "zstd", asbytes=True))


def _unpacked(size: int, raw: bytes) -> Bitmap:
    return Bitmap(np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True), np.uint8))


def bitmap(keys: DataFrame, most_bits: int) -> Bitmap:
    """The bitmap of a long column `key`: about 32 bits for each key, at most most_bits whatever the input's size.

    Bits are gathered 64 at a time by a grouped OR. When there are more keys than bits, more lines than needed pass:
    that costs work, not results.
    """
    with shuffles_removed(keys.sparkSession):
        n = keys.count()
        size = 64
        while size < min(32 * n, most_bits):
            size *= 2
        at = F.col("key").bitwiseAND(F.lit(size - 1))
        words = keys.select(F.call_function("shiftright", at, F.lit(6)).alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        words = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b"))).alias("v")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return Bitmap(out.view(np.uint8))
