"""Seeded inputs and comparison of two implementations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths that inputs have before random ones.
LENGTHS = (1, 2, 3, 7, 8, 16, 64, 255, 256, 1024)
EDGES = (b"", b"\x00", b"\xff", b"a", b"abc", b"123456789", b"\x00" * 16, b"\xff" * 16, bytes(range(256)), b"The quick brown fox jumps over the lazy dog")


def byte_inputs(spark: SparkSession, n: int, seed: int = 0, longest: int = 2048) -> DataFrame:
    """(idx, input): edge cases, then fixed lengths, then random ones; row idx depends on the seed and idx alone."""

    def make(i: int) -> bytes:
        if i < len(EDGES):
            return EDGES[i]
        rng = np.random.default_rng((seed, i))
        size = LENGTHS[i - len(EDGES)] if i < len(EDGES) + len(LENGTHS) else int(rng.integers(0, longest + 1))
        return rng.bytes(size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"idx": f["id"], "input": [make(int(i)) for i in f["id"]]})

    return spark.range(n).mapInPandas(run, "idx long, input binary")


def same_float(a: Column, b: Column, ulps: int = 4) -> Column:
    """Doubles within so many units in the last place; NaN equals nothing."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        def order(v: pd.Series) -> np.ndarray:
            bits = v.to_numpy(np.float64).view(np.int64)
            return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)

        gap = order(x).astype(object) - order(y).astype(object)
        return pd.Series([abs(g) <= ulps for g in gap]) & x.notna() & y.notna()

    return near(a, b)


def round_trip(data: Column, level: int = 6) -> Column:
    """Whether DEFLATE of the bytes inflates to the same bytes."""

    @F.pandas_udf("boolean")
    def same(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else zlib.decompress(zlib.compress(bytes(b), level)) == bytes(b))

    return same(data.cast("binary"))


def deflate(data: Column, level: int = 6) -> Column:
    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else zlib.compress(bytes(b), level))

    return pack(data.cast("binary"))


def inflate(data: Column) -> Column:
    @F.pandas_udf("binary")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else zlib.decompress(bytes(b)))

    return unpack(data)


def aes_block(data: Column, key: Column) -> Column:
    """One AES block in ECB: the first 16 bytes of the padded result."""
    return F.substr(F.aes_encrypt(data, key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.lit(16))
