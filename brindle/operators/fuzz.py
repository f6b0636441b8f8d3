"""Seeded inputs of any parameter types: every value is a function of seed, row and name, so any partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the integer types; a signed one begins with i.
INTEGERS = {"u8": 8, "u16": 16, "u32": 32, "u64": 63, "usize": 32, "i8": 8, "i16": 16, "i32": 32, "i64": 64}
#: Lengths that byte strings have in the rows before the random ones.
LENGTHS = (0, 1, 2, 3, 7, 8, 16, 64, 255, 256)


def digits(seed: int, row: Column, name: str, block: Column | int = 0) -> Column:
    """32 hexadecimal digits that depend on seed, row, name and block only."""
    return F.md5(F.concat(F.lit(f"{seed}:{name}:"), row.cast("string"), F.lit(":"), (F.lit(block) if isinstance(block, int) else block).cast("string")))


def _number(hex_digits: Column, start: int, count: int) -> Column:
    return F.conv(F.substring(hex_digits, start, count), 16, 10).cast("bigint")


def integer(seed: int, row: Column, name: str, kind: str) -> Column:
    """A value of the type: least, greatest and 1 in rows 0, 1 and 2, then evenly spread ones. u64 stays below 2 ** 63."""
    bits = INTEGERS[kind]
    signed = kind.startswith("i")
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    raw = _number(digits(seed, row, name), 1, 15)
    if bits < 60:
        value = raw % F.lit(1 << bits) + F.lit(low)
    else:
        value = raw * 8 + _number(digits(seed, row, name), 16, 1) % 8
        value = F.when(_number(digits(seed, row, name), 17, 1) % 2 == 1, -value - 1).otherwise(value) if signed else value
    return F.when(row == 0, F.lit(low)).when(row == 1, F.lit(high)).when(row == 2, F.lit(1)).otherwise(value).cast("bigint")


def byte_string(seed: int, row: Column, name: str, longest: int = 256) -> Column:
    """Bytes of LENGTHS in the first rows, then of random length up to longest."""
    fixed = F.get(F.array(*[F.lit(n) for n in LENGTHS]), row.cast("int"))
    size = F.coalesce(F.when(row < len(LENGTHS), fixed), (_number(digits(seed, row, name), 1, 8) % (longest + 1)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(size / 16).cast("int"), F.lit(1))), lambda i: digits(seed, row, name, i))
    return F.unhex(F.substr(F.array_join(blocks, ""), F.lit(1), size * 2))


def value_of(kind: str, seed: int, row: Column, name: str, longest: int = 256) -> Column:
    """A value of a Rust type: integers as bigint, bool, floats as double, byte vectors and slices as binary, strings as hex."""
    bare = kind.replace(" ", "").removeprefix("&mut").removeprefix("&")
    if bare in INTEGERS:
        return integer(seed, row, name, bare)
    if bare == "bool":
        return F.when(row < 2, row == 1).otherwise(_number(digits(seed, row, name), 1, 1) % 2 == 1)
    if bare in ("f32", "f64"):
        return F.when(row == 0, F.lit(0.0)).otherwise((_number(digits(seed, row, name), 1, 8) - (1 << 31)) / F.lit(1 << 16))
    if bare in ("[u8]", "Vec<u8>", "alloc::vec::Vec<u8>"):
        return byte_string(seed, row, name, longest)
    if bare in ("str", "String"):
        return F.lower(F.hex(byte_string(seed, row, name, longest // 2)))
    raise ValueError(f"no inputs of type {kind}")


def fuzz_inputs(rows: DataFrame, parameters: list[tuple[str, str]], row: str = "idx", seed: int = 0, longest: int = 256) -> DataFrame:
    """rows with a column of inputs for each (name, type). Edge cases come in the first rows of `row`, from 0."""
    return rows.select("*", *[value_of(kind, seed, F.col(row).cast("bigint"), name, longest).alias(name) for name, kind in parameters])


def transform_inputs(rows: DataFrame, parameters: list[tuple[str, str]], row: str = "idx", seed: int = 0, longest: int = 256) -> DataFrame:
    """fuzz_inputs for a transformation of bytes: an integer parameter whose name ends in len or length is the size of the
    byte parameter before it, so that the pair is one that a caller could pass."""
    out = fuzz_inputs(rows, parameters, row, seed, longest)
    data = None
    for name, kind in parameters:
        if out.schema[name].dataType.simpleString() == "binary":
            data = name
        elif data and kind.replace("&mut ", "") in INTEGERS and name.lower().endswith(("len", "length")):
            out = out.withColumn(name, F.octet_length(data).cast("bigint"))
    return out


def literal(value: Column, kind: str) -> Column:
    """A value as a Rust literal of its type."""
    bare = kind.strip()
    if bare in INTEGERS:
        text = F.concat(value.cast("string"), F.lit(bare))
        return F.when(value < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    if bare == "bool":
        return value.cast("string")
    if bare in ("&[u8]", "Vec<u8>"):
        pairs = F.transform(F.sequence(F.lit(0), F.octet_length(value) - 1), lambda i: F.substring(F.hex(value), i * 2 + 1, F.lit(2)))
        pairs = F.when(F.octet_length(value) > 0, pairs).otherwise(F.array().cast("array<string>"))
        if bare == "&[u8]":
            return F.concat(F.lit("&["), F.array_join(F.transform(pairs, lambda x: F.concat(F.lit("0x"), F.lower(x), F.lit("u8"))), ", "), F.lit("]"))
        return F.concat(F.lit("vec!["), F.array_join(F.transform(pairs, lambda x: F.concat(F.conv(x, 16, 10), F.lit("u8"))), ", "), F.lit("]"))
    return F.lit("Default::default()")


def fuzz_state(rows: DataFrame, fields: list[tuple[str, str]], arguments: list[tuple[str, str]], after: Callable[[dict[str, Column]], dict[str, Column]], row: str = "idx", seed: int = 0, longest: int = 32) -> DataFrame:
    """(row, inputs map, expected): vectors of a function that changes a state. fields and arguments are (name, type); `after`
    gives the changed fields' expressions from all columns by name. inputs holds literals of state.<field> and
    arguments, expected a line `field:type=literal` for each changed field in order of fields."""
    made = fuzz_inputs(rows.select(row), [*fields, *arguments], row, seed, longest)
    changed = after({n: F.col(n) for n, _ in [*fields, *arguments]})
    inputs = F.create_map(*[x for n, k in fields for x in (F.lit(f"state.{n}"), literal(F.col(n), k))], *[x for n, k in arguments for x in (F.lit(n), literal(F.col(n), k))])
    lines = [F.concat(F.lit(f"{n}:{k}="), literal(changed[n], k)) for n, k in fields if n in changed]
    return made.select(row, inputs.alias("inputs"), F.concat_ws("\n", *lines).alias("expected"))
