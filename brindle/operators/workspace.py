"""Checks of a whole workspace: functions that crates lack, errors by file, what a rewrite may change, what counts as an algorithm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.relational import name_variants
from brindle.operators.textscan import public_functions

#: Return types that may be corrected, from and to; pairs of widths that depend on the platform.
FIXES = (("bool", "i32"), ("u8", "i32"), ("u16", "i32"), ("u32", "()"), ("u64", "()"), ("i32", "()"), ("i64", "()"), ("bool", "()"))
WIDE_WORD = "z_word_t"


def check_workspace(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(crate, module, algorithm, name, found) of expected (crate, module, algorithm, name): whether a file of the crate in
    files (crate, text) has a public function of that name or a variant of it.

    Names meet by an equi-join on crate and name; a crate with a third of all functions is split by the join.
    """
    have = files.select("crate", F.explode(public_functions(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("_v")).distinct()
    tried = expected.select("crate", "name", F.explode(name_variants(F.col("name"))).alias("_v")).distinct()
    hit = tried.join(have, ["crate", "_v"]).select("crate", "name").distinct().withColumn("found", F.lit(True))
    return expected.join(hit, ["crate", "name"], "left").select("crate", "module", "algorithm", "name", F.coalesce("found", F.lit(False)).alias("found"))


def workspace_summary(checked: DataFrame) -> DataFrame:
    """(crate, expected, found) by crate, and for all with a null crate: grouping sets of one aggregate."""
    return checked.groupingSets([["crate"], []], "crate").agg(F.count(F.lit(1)).alias("expected"), F.count_if("found").alias("found"))


def errors_by_file(lines: DataFrame, root: str = "", chunk: int = 100_000) -> DataFrame:
    """(log, file, n, message) of logs (log, line, text): the error and warning blocks of each file, in order, parted by a
    blank line. A block runs to the next line that begins with error or warning; its file is the last that it points to with
    -->, below root where it is; blocks without one drop out. A log is summed in chunks of lines, see error_blocks."""
    start = F.col("text").rlike("^(error|warning)")
    marked = lines.select("log", "line", "text", F.floor(F.col("line") / chunk).alias("_chunk"), F.when(start, 1).otherwise(0).alias("_start"))
    inside = Window.partitionBy("log", "_chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("log").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("log", "_chunk").agg(F.sum("_start").alias("_n")).select("log", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = marked.withColumn("_own", F.sum("_start").over(inside)).join(carried, ["log", "_chunk"]).withColumn("block", F.col("_own") + F.col("_before")).where("block > 0")
    place = F.nullif(F.trim(F.regexp_extract("text", r"^\s*-->\s+([^:]+):[0-9]+:[0-9]+", 1)), F.lit(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    blocks = numbered.withColumn("_file", place).groupBy("log", "block").agg(F.max_by("_file", F.when(F.col("_file").isNotNull(), F.col("line"))).alias("file"), text.alias("message")).where("file is not null")
    below = F.replace("file", F.lit("\\"), F.lit("/"))
    below = F.when(F.lit(bool(root)) & F.startswith(below, F.lit(root.rstrip("/") + "/")), F.substr(below, F.lit(len(root.rstrip("/")) + 2))).otherwise(below)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "message"))), lambda x: x["message"]), "\n\n")
    return blocks.withColumn("file", below).groupBy("log", "file").agg(F.count(F.lit(1)).alias("n"), whole.alias("message"))


def only_mutability_differs(current: Column, expected: Column) -> Column:
    """Whether two types differ in &mut and & alone."""
    plain = lambda t: F.trim(F.replace(F.replace(t, F.lit("&mut "), F.lit("")), F.lit("&"), F.lit("")))
    return (current != expected) & (plain(current) == plain(expected))


def safe_return_fix(stated: Column, expected: Column, c_type: Column | None = None) -> Column:
    """Whether a stated return type may be corrected to the expected one: FIXES, and u32 and u64 for each other where C
    has a word of the platform's width; never a type with parameters or references."""
    s, e, c = F.trim(stated), F.trim(expected), F.trim(F.coalesce(c_type if c_type is not None else F.lit(None).cast("string"), F.lit("")))
    known = F.concat_ws(">", s, e).isin(*[">".join(f) for f in FIXES])
    wide = (c == WIDE_WORD) & F.concat_ws(">", s, e).isin("u32>u64", "u64>u32")
    return ~s.rlike("Result|Option|<|&") & (known | wide)


def safe_constant(expression: Column) -> Column:
    """Whether a C expression holds numbers, characters, names and operators only, and calls nothing. An empty one does."""
    token = r"\s+|(?:0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+)[uUlL]*|'[^']'|[A-Za-z_]\w*|[()+\-*/<>|&^~%]"
    return (F.regexp_replace(expression, token, "") == "") & ~expression.rlike(r"[A-Za-z_]\w*\s*\(")


def function_class(name: Column, purpose: Column) -> Column:
    """main, build_utility, test_harness or algorithm, by name first, then by what the purpose says."""
    low = F.lower(name)
    builds = (F.startswith(low, F.lit("write_table")) | F.startswith(low, F.lit("gen_"))) & F.contains(low, F.lit("header"))
    says = F.lower(F.coalesce(purpose, F.lit(""))).rlike(r"generates?\s+c\s+source|writes?\s+to\s+file|code\s+generation")
    return F.when(name == "main", "main").when(builds, "build_utility").when(low.rlike("test|example"), "test_harness").when(says, "build_utility").otherwise("algorithm")


def without_build_utilities(specs: DataFrame) -> DataFrame:
    """specs (algorithms array<struct<name, description, ...>>, ...) with algorithms only; modules left with none drop out.
    The arrays are filtered in place: no row is exploded."""
    kept = specs.withColumn("algorithms", F.filter("algorithms", lambda a: function_class(a["name"], a["description"]) == "algorithm"))
    return kept.where("size(algorithms) > 0")
