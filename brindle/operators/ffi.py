"""C types as the types of a foreign function interface, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: C scalars, the names that zlib's headers give them, truth values, and the Rust types of all.
FFI_TYPES = {
    "void": "()",
    "char": "c_char", "signed char": "c_schar", "unsigned char": "c_uchar",
    "short": "c_short", "short int": "c_short", "unsigned short": "c_ushort", "unsigned short int": "c_ushort",
    "int": "c_int", "signed int": "c_int", "unsigned": "c_uint", "unsigned int": "c_uint",
    "long": "c_long", "long int": "c_long", "unsigned long": "c_ulong", "unsigned long int": "c_ulong",
    "long long": "c_longlong", "long long int": "c_longlong", "unsigned long long": "c_ulonglong",
    "float": "c_float", "double": "c_double",
    "size_t": "usize", "ssize_t": "isize", "ptrdiff_t": "isize", "intptr_t": "isize", "uintptr_t": "usize",
    "int8_t": "i8", "int16_t": "i16", "int32_t": "i32", "int64_t": "i64",
    "uint8_t": "u8", "uint16_t": "u16", "uint32_t": "u32", "uint64_t": "u64",
    "Byte": "c_uchar", "Bytef": "c_uchar", "uInt": "c_uint", "uIntf": "c_uint", "uLong": "c_ulong", "uLongf": "c_ulong", "voidp": "*mut c_void", "voidpf": "*mut c_void", "voidpc": "*const c_void", "z_off_t": "c_long",
    "_Bool": "bool", "bool": "bool",
}


def c_type(text: Column) -> Column:
    """struct(base, is_const, depth, is_array): is_const is that of what the innermost pointer points to; an array counts as a pointer."""
    bare = F.regexp_replace(F.trim(text), r"(\s*\[[^\[\]]*\])+$", "")
    is_array = F.trim(text).rlike(r"\]$")
    base = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(const|volatile)\b|\*", " "), r"\s+", " "))
    depth = F.length(bare) - F.length(F.replace(bare, F.lit("*"), F.lit(""))) + is_array.cast("int")
    return F.struct(base.alias("base"), bare.rlike(r"^[^*]*\bconst\b").alias("is_const"), depth.alias("depth"), is_array.alias("is_array"))


def _lookup(names: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key] if names else F.lit(None).cast("string")


def ffi_type(text: Column, typedefs: Mapping[str, str] | None = None, opaque: Iterable[str] = ()) -> Column:
    """The Rust type of a C type: scalars first, then `typedefs`, then names that are `opaque`. Another name stays, behind a pointer it is c_void."""
    t = c_type(text)
    name, depth = F.regexp_replace(t["base"], r"^(struct|union|enum)\s+", ""), t["depth"]
    known = F.when((name == "void") & (depth > 0), "c_void").otherwise(_lookup(FFI_TYPES, name))
    target = F.coalesce(known, _lookup(dict(typedefs or {}), name), _lookup({x: x for x in opaque}, name), F.when(depth > 0, "c_void"), name)
    inner = F.when(depth == 0, "").when(t["is_const"], "*const ").otherwise("*mut ")
    return F.concat(F.repeat(F.lit("*mut "), depth - 1), inner, target)
