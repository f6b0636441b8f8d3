"""Checksums and digests of binary or string columns, as expressions; Adler-32 and CRC-32C are worked out in Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Moduli and polynomials of RFC 1950, RFC 1952 and Fletcher's sum.
ADLER_BASE = 65521
CRC_POLY = 0xEDB88320
CRC_MSB_POLY = 0x04C11DB7
CRC32C_POLY = 0x82F63B78
FLETCHER_BASE = 255
MASK32 = 0xFFFFFFFF


def byte_values(data: Column) -> Column:
    """array<int> of the bytes."""
    pairs = F.regexp_extract_all(F.hex(data.cast("binary")), F.lit("([0-9A-F]{2})"), F.lit(1))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def _bind(value: Column, use) -> Column:
    """use(value) with value worked out once, also inside lambdas.

    Columns of the caller belong into value: inside a lambda their names may find an alias of the same select instead.
    """
    return F.transform(F.array(value), use)[0]


def adler32(data: Column, seed: int = 1) -> Column:
    """Adler-32; seed as in running sums. zlib reads the bytes, in Arrow batches: a fold of expressions takes half a microsecond
    for each."""

    @F.pandas_udf("bigint")
    def sums(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else zlib.adler32(v, seed) for v in values], dtype="Int64")

    return sums(data.cast("binary"))


def fletcher16(data: Column) -> Column:
    kind = "struct<a:bigint,b:bigint>"
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).cast(kind)

    def add(s: Column, x: Column) -> Column:
        a = (s["a"] + x) % FLETCHER_BASE
        return F.struct(a.alias("a"), ((s["b"] + a) % FLETCHER_BASE).alias("b")).cast(kind)

    return F.aggregate(byte_values(data), start, add, lambda s: s["b"] * 256 + s["a"])


def fletcher32(words: Column) -> Column:
    """Two sums modulo 65535 over an array of 16-bit words: the second weighs each word by its place from the end, so
    neither is folded."""
    place = lambda s: F.transform(s, lambda w, i: (F.size(s) - i).cast("bigint") % 65535 * w % 65535)
    total = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: (a + x) % 65535)
    return _bind(words, lambda s: total(place(s)) * 65536 + total(s))


def adler32_combine(adler1: Column, adler2: Column, len2: Column) -> Column:
    """Adler-32 of two joined strings from their sums and the second's length."""
    a1, b1 = adler1 % 65536, F.floor(adler1 / 65536)
    a2, b2 = adler2 % 65536, F.floor(adler2 / 65536)
    a = F.pmod(a1 + a2 - 1, F.lit(ADLER_BASE))
    b = F.pmod(b1 + b2 + (len2 % ADLER_BASE) * F.pmod(a1 - 1, F.lit(ADLER_BASE)), F.lit(ADLER_BASE))
    return (b * 65536 + a).cast("bigint")


def crc_table(poly: int = CRC_POLY) -> list[int]:
    """256 entries of a reflected CRC, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (poly if c & 1 else 0)
        out.append(c)
    return out


def crc_reflected(data: Column, seed: int = 0, poly: int = CRC_POLY) -> Column:
    """Reflected CRC-32 of any polynomial; seed as in running sums."""
    table = F.array(*[F.lit(x).cast("bigint") for x in crc_table(poly)])
    begin = F.lit(seed ^ MASK32).cast("bigint")
    step = lambda s: F.aggregate(s["bytes"], begin, lambda c, x: F.shiftright(c, 8).bitwiseXOR(F.get(s["table"], c.bitwiseXOR(x.cast("bigint")).bitwiseAND(F.lit(255)).cast("int"))))
    return _bind(F.struct(table.alias("table"), byte_values(data).alias("bytes")), step).bitwiseXOR(F.lit(MASK32))


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def crc32c(data: Column) -> Column:
    """CRC-32 with Castagnoli's polynomial: crc_reflected's fold, over bytes in Arrow batches."""
    table = np.array(crc_table(CRC32C_POLY), np.uint32)

    @F.pandas_udf("bigint")
    def sums(values: pd.Series) -> pd.Series:
        given = [v or b"" for v in values]
        out = np.full(len(given), MASK32, np.uint32)
        size = np.array([len(v) for v in given], np.int64)
        order = np.argsort(-size, kind="stable")
        # byte k of up to 4,096 rows at a time, the longest first; where few rows are left, a row at a time
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096]
            k = int(size[rows[min(16, len(rows)) - 1]]) if len(rows) >= 16 else 0
            for begin in range(0, k, 1024):
                live = rows[: np.count_nonzero(size[rows] > begin)]
                block = np.frombuffer(b"".join(given[r][begin : begin + 1024].ljust(1024, b"\0") for r in live), np.uint8).reshape(-1, 1024)
                c, left = out[live], size[live] - begin
                for x in range(min(1024, k - begin)):
                    n = np.count_nonzero(left > x)
                    c[:n] = c[:n] >> np.uint32(8) ^ table[(c[:n] ^ block[:n, x]) & np.uint32(255)]
                out[live] = c
            for r in rows[size[rows] > k].tolist():
                c, plain = int(out[r]), table.tolist()
                for x in given[r][k:]:
                    c = c >> 8 ^ plain[(c ^ x) & 255]
                out[r] = c
        return pd.Series((out ^ np.uint32(MASK32)).astype(np.int64), dtype="Int64").mask(values.isna())

    return sums(data.cast("binary"))


def crc32_msb(data: Column) -> Column:
    """CRC-32 with the most significant bit first, all-ones start and end."""

    def step(c: Column, x: Column) -> Column:
        c = c.bitwiseXOR(F.shiftleft(x.cast("bigint"), 24))
        shift = lambda v, _: F.when(v.bitwiseAND(F.lit(1 << 31)) != 0, F.shiftleft(v, 1).bitwiseXOR(F.lit(CRC_MSB_POLY))).otherwise(F.shiftleft(v, 1)).bitwiseAND(F.lit(MASK32))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), c, shift)

    return F.aggregate(byte_values(data), F.lit(MASK32).cast("bigint"), step).bitwiseXOR(F.lit(MASK32))


def multmodp(a: Column, b: Column) -> Column:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected; 0 for a = 0."""
    return _bind(F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), lambda s: _multmodp(s["a"], s["b"]))


def _multmodp(a: Column, b: Column) -> Column:
    kind = "struct<p:bigint,b:bigint>"
    start = F.struct(F.lit(0).alias("p"), b.alias("b")).cast(kind)

    def step(s: Column, i: Column) -> Column:
        p = F.when(F.getbit(a, i) == 1, s["p"].bitwiseXOR(s["b"])).otherwise(s["p"])
        half = F.shiftright(s["b"], 1)
        return F.struct(p.alias("p"), F.when(s["b"] % 2 == 1, half.bitwiseXOR(F.lit(CRC_POLY))).otherwise(half).alias("b")).cast(kind)

    return F.aggregate(F.sequence(F.lit(31), F.lit(0), F.lit(-1)), start, step, lambda s: s["p"])


def _gf_product(a: int, b: int) -> int:
    p = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            p ^= b
        b = (b >> 1) ^ (CRC_POLY if b & 1 else 0)
    return p


def x2nmodp(n: Column, k: Column | int) -> Column:
    """x to the power n * 2 ** k modulo the CRC-32 polynomial."""
    powers, value = [], 1 << 30
    for _ in range(32):
        powers.append(value)
        value = _gf_product(value, value)
    table = F.array(*[F.lit(x).cast("bigint") for x in powers])
    k = k if isinstance(k, Column) else F.lit(k)
    step = lambda s: F.aggregate(
        F.sequence(F.lit(0), F.lit(62)),
        F.lit(1 << 31).cast("bigint"),
        lambda p, i: F.when(F.getbit(s["n"], i) == 1, _multmodp(F.get(s["table"], ((i + s["k"]) % 32).cast("int")), p)).otherwise(p),
    )
    return _bind(F.struct(table.alias("table"), n.cast("bigint").alias("n"), k.alias("k")), step)


def crc32_combine(crc1: Column, crc2: Column, len2: Column) -> Column:
    """CRC-32 of two joined strings from their sums and the second's length."""
    return multmodp(x2nmodp(len2, 3), crc1).bitwiseXOR(crc2)


def crc32_combine_op(crc1: Column, crc2: Column, op: Column) -> Column:
    """The same with the operator of a length ready; op = 0 gives 0."""
    return F.when(op == 0, F.lit(0).cast("bigint")).otherwise(multmodp(op, crc1).bitwiseXOR(crc2))


def digest(data: Column, name: str) -> Column:
    """Hex digest: md5, sha1, sha224, sha256, sha384, sha512."""
    data = data.cast("binary")
    if name == "md5":
        return F.md5(data)
    if name == "sha1":
        return F.sha1(data)
    return F.sha2(data, int(name.removeprefix("sha")))
