"""Global variables of a code base: what is constant, by propagation over the graph of names, and how each is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.staging import staged

#: C scalar types with their Rust types; calls that a constant may make.
SCALARS = {
    "int": "i32", "unsigned": "u32", "unsigned int": "u32", "long": "i64", "unsigned long": "u64", "short": "i16", "unsigned short": "u16", "char": "i8", "unsigned char": "u8",
    "uint8_t": "u8", "uint16_t": "u16", "uint32_t": "u32", "uint64_t": "u64", "int8_t": "i8", "int16_t": "i16", "int32_t": "i32", "int64_t": "i64", "size_t": "usize",
    "ssize_t": "isize", "float": "f32", "double": "f64",
}
INTEGRAL = tuple(t for t in SCALARS if t not in ("float", "double")) + ("uintptr_t",)
PLAIN_CALLS = ("min", "max")
GLOBAL = "name, c_type, is_const, is_extern, init_code, has_init_function, is_mutated_after_init"

_ARRAY = r"^(.*?)\s*\[\s*([0-9]+)\s*\]$"


def is_const_computable(name: Column, init_code: Column, constant: Column | None = None) -> Column:
    """Whether a value comes from literals, indices and itself: code that is there and calls nothing but its own name, min,
    max and, if given, the functions of `constant` (array<string>)."""
    calls = F.array_distinct(F.regexp_extract_all(F.coalesce(init_code, F.lit("")), F.lit(r"\b([a-zA-Z_]\w*)\s*\("), F.lit(1)))
    allowed = F.concat(F.array(name, *[F.lit(c) for c in PLAIN_CALLS]), constant if constant is not None else F.array().cast("array<string>"))
    return (F.length(F.coalesce(init_code, F.lit(""))) > 0) & (F.size(F.array_except(calls, allowed)) == 0)


def constant_names(defined: DataFrame) -> DataFrame:
    """(name, depth) of defined (name, code, fixed): names whose value is constant. fixed names never are.

    A name is constant if its code refers to no other defined name but constant ones (itself aside); depth is the
    longest chain of such references. Names that aren't defined, keywords and indices among them, don't count. On a
    cycle no name is constant, nor is any that refers to one.

    Each round takes the names whose last open reference went with the round before: a join of what became constant with
    the references to it and a grouped count, so the work of all rounds together is that of the references once, and
    the rounds are the depth. A name that a third of all others refer to is split by the join's skew handling.
    """
    known = staged(defined.where("name is not null").groupBy("name").agg(F.max(F.coalesce("fixed", F.lit(False))).alias("fixed"), F.concat_ws(";", F.collect_set("code")).alias("code")), "names")
    words = known.select("name", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("uses")).where("uses <> name")
    refs = staged(words.join(known.select(F.col("name").alias("uses")), "uses").select("name", "uses"), "references")
    waiting = known.where("not fixed").select("name").join(refs.groupBy("name").agg(F.count(F.lit(1)).alias("open")), "name", "left").select("name", F.coalesce("open", F.lit(0)).alias("open"))
    waiting = staged(waiting, "waiting")
    found = new = staged(waiting.where("open = 0").select("name", F.lit(0).alias("depth")), "constant")
    waiting = waiting.where("open > 0")
    depth = 0
    while not new.isEmpty():
        depth += 1
        done = refs.join(new.select(F.col("name").alias("uses")), "uses").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        waiting = staged(waiting.join(done, "name", "left").select("name", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open")), "waiting")
        new = staged(waiting.where("open = 0").select("name", F.lit(depth).alias("depth")), "constant")
        waiting = waiting.where("open > 0")
        found = found.unionByName(new)
    return found


def scalar_type(base: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in SCALARS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.trim(base)), F.lit("u32"))


def classify_globals(globals_: DataFrame, constant: DataFrame | None = None) -> DataFrame:
    """globals_ (GLOBAL columns) with strategy, rust_type and rust_init.

    In order: opaque_extern for extern or void; const_table for an array that nothing mutates and that is const, or
    computable from literals and constant names (constant: (name), see constant_names; without it from literals only);
    lazy_init for what an init function sets once; atomic for a mutated integer; arc_mutex for anything else mutated; const_table
    for other scalars. Null flags count as false, a null type as int.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = globals_
    if constant is not None:
        rows = rows.join(constant.select("name", F.lit(True).alias("_constant")), "name", "left")
    c_type = F.trim(F.coalesce(F.col("c_type"), F.lit("int")))
    is_array = c_type.rlike(_ARRAY)
    base, size = F.when(is_array, F.trim(F.regexp_extract(c_type, _ARRAY, 1))).otherwise(c_type), F.regexp_extract(c_type, _ARRAY, 2).try_cast("bigint").cast("string")
    elem = scalar_type(base)
    whole = F.when(is_array, F.concat(F.lit("["), elem, F.lit("; "), size, F.lit("]"))).otherwise(elem)
    mutated = flag("is_mutated_after_init")
    computable = is_const_computable(F.col("name"), F.col("init_code"))
    if constant is not None:
        computable = computable | flag("_constant") & (F.length(F.coalesce("init_code", F.lit(""))) > 0)
    strategy = (
        F.when(flag("is_extern") | F.contains(c_type, F.lit("void")), "opaque_extern")
        .when(is_array & ~mutated & (flag("is_const") | computable), "const_table")
        .when(flag("has_init_function") & ~mutated, "lazy_init")
        .when(mutated & ~is_array & base.isin(*INTEGRAL), "atomic")
        .when(mutated, "arc_mutex")
        .otherwise("const_table")
    )
    s, name, upper = F.col("strategy"), F.col("name"), F.upper("name")
    atomic = F.concat(F.lit("AtomicU"), F.coalesce(F.nullif(F.regexp_extract(elem, "([0-9]+)$", 1), F.lit("")), F.lit("32")))
    rust_type = (
        F.when(s == "opaque_extern", "*mut c_void /* behind safe wrapper */")
        .when(s == "lazy_init", F.concat(F.lit("std::sync::LazyLock<"), whole, F.lit(">")))
        .when(s == "atomic", atomic)
        .when(s == "arc_mutex", F.concat(F.lit("Arc<Mutex<"), whole, F.lit(">>")))
        .otherwise(whole)
    )
    table = is_array & (flag("is_const") | computable)
    init = (
        F.when(s == "opaque_extern", "std::ptr::null_mut()")
        .when(s == "lazy_init", F.concat(F.lit("static "), upper, F.lit(": LazyLock<"), whole, F.lit("> = LazyLock::new(|| init_"), name, F.lit("());")))
        .when(s == "atomic", F.concat(atomic, F.lit("::new(0)")))
        .when(s == "arc_mutex", "Arc::new(Mutex::new(Default::default()))")
        .when(table, F.concat(F.lit("const "), upper, F.lit(": "), whole, F.lit(" = { /* computed at compile time */ };")))
        .otherwise(F.concat(F.lit("const "), upper, F.lit(": "), whole, F.lit(" = 0;")))
    )
    return rows.withColumn("strategy", strategy).withColumn("rust_type", rust_type).withColumn("rust_init", init).drop("_constant")
