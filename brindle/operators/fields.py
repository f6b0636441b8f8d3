"""Fields of shared types: what specifications state and what code uses, merged into one schema per type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field whose type isn't known.
UNKNOWN = "?"
#: Names that code gives to state, names after a dot that are methods, and types of well-known fields by type.
HOLDERS = ("state", "self", "stream", "strm", "s")
METHODS = (
    "as_bytes", "as_mut", "as_ref", "as_str", "borrow", "borrow_mut", "clone", "contains", "default", "extend_from_slice", "fmt", "from", "into", "is_empty", "is_none", "is_some",
    "iter", "len", "max", "min", "new", "next", "push", "rev", "starts_with", "to_string", "to_vec", "unwrap",
)
FIELD_TYPES = {
    "usize": ("size", "len", "strstart", "lookahead", "match_start", "pos", "start", "hash_size", "w_size", "w_mask"),
    "u32": (
        "length", "count", "bits", "mode", "state", "head", "tail", "next", "ins_h", "w_bits", "wsize", "wbits", "whave", "wnext", "window_bits", "window_size", "adler", "check", "dmax",
        "dict_id", "lenfix_width", "distfix_width", "lenbits", "distbits", "hold", "length_extra", "extra", "ncode", "nlen", "ndist", "was", "match_length", "distance", "offset", "codes",
    ),
    "u64": ("total", "total_in", "total_out"),
    "alloc::vec::Vec<u8>": ("buffer", "window", "data", "pending"),
    "Option<alloc::vec::Vec<u8>>": ("next_in", "next_out"),
    "i32": ("flags", "wrap", "back", "level", "strategy", "mem_level"),
    "bool": ("fastest", "last", "havedict", "have_dict", "sane", "half"),
    "i64": ("block_start",),
    "alloc::vec::Vec<usize>": ("prev",),
    "alloc::vec::Vec<u16>": ("lens", "work"),
    "Option<&'static str>": ("msg",),
}
FIELDS = "type_name string, field string, rust_type string, source string, at struct<origin:int,place:bigint>"


def field_type(name: Column) -> Column:
    """The type of a well-known field, u32 for others."""
    known = F.create_map(*[F.lit(x) for kind, names in FIELD_TYPES.items() for n in names for x in (n, kind)])
    return F.coalesce(F.try_element_at(known, name), F.lit("u32"))


def _rows(df: DataFrame, type_name: Column, field: Column, kind: Column, source: Column, origin: int, place: Column) -> DataFrame:
    at = F.struct(F.lit(origin).alias("origin"), place.cast("bigint").alias("place"))
    return df.select(type_name.alias("type_name"), field.alias("field"), F.coalesce(kind, F.lit(UNKNOWN)).alias("rust_type"), source.alias("source"), at.alias("at"))


def spec_fields(specs: DataFrame) -> DataFrame:
    """(type_name, field, rust_type, source, at) of specs (at, name, shared_types, algorithms): a row per field that a
    shared type states, and per state variable of an algorithm, whose type is `<algorithm>_state`.

    `at` orders the specs; all shared types come before all state. Null arrays state nothing; a null type is unknown.
    """
    shared = specs.select("at", "name", F.posexplode("shared_types").alias("i", "t")).select("at", "name", "i", F.col("t.name").alias("t"), F.posexplode("t.fields").alias("j", "f"))
    algos = specs.select("at", F.posexplode("algorithms").alias("i", "a")).select("at", "i", F.col("a.name").alias("a"), F.posexplode("a.state").alias("j", "f"))
    place = F.col("at") * (1 << 32) + F.col("i") * (1 << 16) + F.col("j")
    source = lambda kind, name: F.concat(F.lit(f"{kind}["), F.coalesce(name, F.lit("")), F.lit("]"))
    stated = _rows(shared, F.col("t"), F.col("f.name"), F.col("f.rust_type"), source("shared_types", F.col("name")), 0, place)
    kept = _rows(algos, F.concat("a", F.lit("_state")), F.col("f.name"), F.col("f.rust_type"), source("state", F.col("a")), 1, place)
    return stated.unionByName(kept).where("type_name is not null and field is not null")


def code_fields(files: DataFrame, path: str, text: str, type_name: str = "state") -> DataFrame:
    """The same rows from `state.field` and the like in code: one per file and field, methods left out, types by name."""
    used = rf"\b(?:{'|'.join(HOLDERS)})\b(?:\.as_mut\(\)\.unwrap\(\))?\.([a-z_][a-z0-9_]*)"
    found = files.select(F.col(path).cast("string").alias("_p"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text).cast("string"), F.lit(used), F.lit(1)))).alias("f"))
    return _rows(found.where(~F.col("f").isin(*METHODS)), F.lit(type_name), F.col("f"), field_type(F.col("f")), F.col("_p"), 2, F.xxhash64("_p"))


def merge_fields(rows: DataFrame) -> DataFrame:
    """(type_name, field, rust_type, sources, kinds) of field rows, or of rows that this function gave.

    The type is the first known one in order of `at`, UNKNOWN if none is; sources are all, sorted; kinds are the
    different known types, so more than one is a conflict. Each is a minimum or a set over the rows, so that any split
    of the rows, merged part by part in any order, gives the same, and Spark combines them before the shuffle: a
    field in a third of all files is a row for each task.
    """
    known = F.col("rust_type") != UNKNOWN
    sources = F.col("sources") if "sources" in rows.columns else F.array("source")
    kinds = F.col("kinds") if "kinds" in rows.columns else F.when(known, F.array("rust_type")).otherwise(F.array().cast("array<string>"))
    each = rows.select("type_name", "field", "rust_type", F.col("at"), sources.alias("s"), kinds.alias("k"))
    best = F.min(F.when(F.col("rust_type") != UNKNOWN, F.struct("at", "rust_type"))).alias("best")
    typed = each.groupBy("type_name", "field").agg(best, F.min("at").alias("first"))
    # sets are gathered of distinct values, a row each until the last step
    spread = lambda c: each.select("type_name", "field", F.explode(c).alias("x")).distinct().groupBy("type_name", "field").agg(F.array_sort(F.collect_list("x")).alias(c))
    out = typed.join(spread("s"), ["type_name", "field"], "left").join(spread("k"), ["type_name", "field"], "left")
    none = F.array().cast("array<string>")
    return out.select("type_name", "field", F.coalesce("best.rust_type", F.lit(UNKNOWN)).alias("rust_type"), F.coalesce("s", none).alias("sources"), F.coalesce("k", none).alias("kinds"), F.coalesce("best.at", "first").alias("at"))


def render_structs(merged: DataFrame, derives: tuple[str, ...] = ("Debug", "Default")) -> DataFrame:
    """(type_name, code): a struct definition with the type's fields in order of name."""
    line = F.concat(F.lit("    pub "), "field", F.lit(": "), "rust_type", F.lit(",\n"))
    lines = merged.groupBy("type_name").agg(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))).alias("f"))
    return lines.select("type_name", F.concat(F.lit(f"#[derive({', '.join(derives)})]\npub struct "), "type_name", F.lit(" {\n"), F.array_join("f.line", ""), F.lit("}")).alias("code"))
