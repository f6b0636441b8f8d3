"""Byte and bit arithmetic, and the bit-buffer steps of a deflate writer, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import _bind, byte_values, crc_table

BUFFER = "struct<bi_buf:bigint,bi_valid:int,pending:array<int>>"


def byte_swap(word: Column) -> Column:
    """The eight bytes of a 64-bit word in reverse, as hex (unsigned values outgrow bigint)."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(word.cast("bigint")), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.array_join(F.reverse(pairs), "")


def bit_reverse(code: Column, length: Column) -> Column:
    """The low `length` (modulo 32) bits of code in reverse; length 0 gives 0."""

    def turn(s: Column) -> Column:
        bits = F.aggregate(F.sequence(F.lit(0), s["n"] - 1), F.lit(0).cast("bigint"), lambda r, i: F.shiftleft(r, 1).bitwiseOR(F.getbit(s["code"], i).cast("bigint")))
        return F.when(s["n"] == 0, F.lit(0).cast("bigint")).otherwise(bits)

    return _bind(F.struct(code.cast("bigint").alias("code"), F.pmod(length, F.lit(32)).cast("int").alias("n")), turn)


def crc_word(word: Column) -> Column:
    """Eight table steps of CRC-32 over a 64-bit word; the low 32 bits."""
    table = F.array(*[F.lit(x).cast("bigint") for x in crc_table()])
    step = lambda t: F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), word.cast("bigint"), lambda w, _: F.call_function("shiftrightunsigned", w, F.lit(8)).bitwiseXOR(F.get(t, w.bitwiseAND(F.lit(255)).cast("int")))
    )
    return F.transform(F.array(table), step)[0].bitwiseAND(F.lit(0xFFFFFFFF))


def crc_word_big(word: Column) -> Column:
    """Eight steps over a 64-bit word from its highest byte down, with the table's entries in reverse byte order; the
    whole word, as hex (unsigned values outgrow bigint)."""
    table = F.array(*[F.lit(int.from_bytes(x.to_bytes(4, "little"), "big")).cast("bigint") for x in crc_table()])
    step = lambda t: F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), word.cast("bigint"), lambda w, _: F.call_function("shiftleft", w, F.lit(8)).bitwiseXOR(F.get(t, F.call_function("shiftrightunsigned", w, F.lit(56)).cast("int")))
    )
    return F.lpad(F.hex(F.transform(F.array(table), step)[0]), 16, "0")


def gen_codes(lengths: Column) -> Column:
    """Canonical Huffman codes (RFC 1951), lowest bit first, of an array of code lengths; null where the length is 0.

    The first code of a length is the sum over all shorter codes of 2 to the power of what they are shorter by; the
    symbols of a length follow it in order.
    """

    def code(s: Column) -> Column:
        first = lambda n: F.aggregate(F.filter(s, lambda m: (m > 0) & (m < n)), F.lit(0).cast("bigint"), lambda a, m: a + F.call_function("shiftleft", F.lit(1).cast("bigint"), (n - m).cast("int")))
        before = lambda n, i: F.size(F.filter(F.slice(s, 1, i), lambda m: m == n))
        return F.transform(s, lambda n, i: F.when(n > 0, bit_reverse(first(n) + before(n, i), n)))

    return _bind(lengths, code)


def compress_bound_simple(n: Column) -> Column:
    """n + n // 1000 + 18; null beyond 64 bits."""
    total = n.cast("decimal(38,0)") + F.floor(n / 1000).cast("decimal(38,0)") + 18
    return F.when(total <= F.lit(2**63 - 1).cast("decimal(38,0)"), total.cast("bigint"))


def compress_bound_deflate(n: Column) -> Column:
    """n + n // 4096 + n // 16384 + n // 33554432 + 13."""
    return n + F.shiftright(n, 12) + F.shiftright(n, 14) + F.shiftright(n, 25) + 13


def compile_flags() -> Column:
    return F.lit(169)


def first_bytes(data: Column, n: Column) -> Column:
    return F.substr(data.cast("binary"), F.lit(1), n)


def zero_bytes(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def compare_bytes(a: Column, b: Column, n: Column) -> Column:
    """The difference at the first differing one of the first n bytes, else 0."""
    pairs = F.zip_with(F.slice(byte_values(a), 1, n), F.slice(byte_values(b), 1, n), lambda x, y: x - y)
    return F.coalesce(F.get(F.filter(pairs, lambda d: d != 0), F.lit(0)), F.lit(0))


def slide(values: Column, window: Column) -> Column:
    """Every element less the window, 0 at least."""
    return _bind(F.struct(values.alias("v"), window.alias("w")), lambda s: F.transform(s["v"], lambda h: F.greatest(h - s["w"], F.lit(0))))


def bit_buffer(bi_buf: Column, bi_valid: Column, pending: Column) -> Column:
    return F.struct(bi_buf.alias("bi_buf"), bi_valid.alias("bi_valid"), pending.alias("pending")).cast(BUFFER)


def bi_flush(s: Column) -> Column:
    """Full bytes of the bit buffer go to pending: two from 16 bits, one from 8."""
    low, high = s["bi_buf"].bitwiseAND(F.lit(255)).cast("int"), F.shiftright(s["bi_buf"], 8).bitwiseAND(F.lit(255)).cast("int")
    two = bit_buffer(F.lit(0), F.lit(0), F.concat(s["pending"], F.array(low, high)))
    one = bit_buffer(F.shiftright(s["bi_buf"], 8), s["bi_valid"] - 8, F.concat(s["pending"], F.array(low)))
    return F.when(s["bi_valid"] == 16, two).when(s["bi_valid"] >= 8, one).otherwise(s)


def bi_windup(s: Column) -> Column:
    """Whatever bits are left go to pending, as one or two bytes, and the buffer is clear."""
    low, high = s["bi_buf"].bitwiseAND(F.lit(255)).cast("int"), F.shiftright(s["bi_buf"], 8).bitwiseAND(F.lit(255)).cast("int")
    more = F.when(s["bi_valid"] > 8, F.array(low, high)).when(s["bi_valid"] > 0, F.array(low)).otherwise(F.array().cast("array<int>"))
    return bit_buffer(F.lit(0), F.lit(0), F.concat(s["pending"], more))


def send_bits(s: Column, value: Column, length: Column) -> Column:
    """Appends the low bits of value to a 16-bit buffer; when it fills, two bytes go to pending."""
    mixed = s["bi_buf"].bitwiseOR(F.call_function("shiftleft", value.cast("bigint"), s["bi_valid"]))
    cut = mixed.bitwiseAND(F.lit(0xFFFF))
    low, high = cut.bitwiseAND(F.lit(255)).cast("int"), F.shiftright(cut, 8).cast("int")
    split = bit_buffer(F.call_function("shiftright", value.cast("bigint"), (16 - s["bi_valid"]).cast("int")), s["bi_valid"] + length - 16, F.concat(s["pending"], F.array(low, high)))
    return F.when(s["bi_valid"] + length > 16, split).otherwise(bit_buffer(cut, s["bi_valid"] + length, s["pending"]))


def data_type(data: Column) -> Column:
    """0 binary, 1 text, 2 unknown: binary has control bytes that texts don't; text has tab, newline, return or any from 32."""
    values = byte_values(data)
    never = [*range(7), *range(14, 26), *range(28, 32)]
    return F.when(F.arrays_overlap(values, F.array(*[F.lit(x) for x in never])), 0).when(F.exists(values, lambda b: b.isin(9, 10, 13) | (b >= 32)), 1).otherwise(2)


def gate_init(columns: list[str]) -> Column:
    """A struct of zero counters."""
    return F.struct(*[F.lit(0).alias(c) for c in columns])
