"""Scanners of source text: comments, functions, constants, findings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C_WORDS = ("if", "for", "while", "switch", "return", "sizeof", "else", "do", "case")
#: C types and the Rust types of the same values.
C_TYPES = {
    "char": "i8", "signed char": "i8", "unsigned char": "u8", "short": "i16", "unsigned short": "u16", "int": "i32", "unsigned": "u32",
    "unsigned int": "u32", "long": "i64", "unsigned long": "u64", "long long": "i64", "unsigned long long": "u64", "float": "f32", "double": "f64",
    "size_t": "usize", "ssize_t": "isize", "int8_t": "i8", "uint8_t": "u8", "int16_t": "i16", "uint16_t": "u16", "int32_t": "i32",
    "uint32_t": "u32", "int64_t": "i64", "uint64_t": "u64", "bool": "bool", "_Bool": "bool", "void": "()",
}


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", "")


def strip_code_comments(text: Column) -> Column:
    """strip_comments for sources with strings: what looks like a comment in a string or character stays."""
    quoted = r"""\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\.)'"""
    return F.regexp_replace(F.regexp_replace(text, rf"({quoted}|//[^\n]*)|/\*[\s\S]*?\*/", "$1 "), rf"({quoted})|//[^\n]*", "$1")


def canonical_body(text: Column) -> Column:
    """Without comments and white space."""
    return F.regexp_replace(strip_comments(text), r"\s+", "")


def strip_line_markers(text: Column) -> Column:
    """Without the lines that start with "# " and hold a quote."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~(F.startswith(x, F.lit("# ")) & F.contains(x, F.lit('"')))), "\n")


def pattern_counts(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("bigint").alias(name) for name, p in patterns.items()]


def public_functions(text: Column) -> Column:
    """Sorted distinct names of functions that are public, be it to the crate or a part of it; comments are left out."""
    head = r"\bpub(?:\s*\(\s*(?:crate|super|self|in\s+[^)]+)\s*\))?\s+(?:(?:const|unsafe|async|extern(?:\s+\"[^\"]*\")?)\s+)*+fn\s+([A-Za-z_][A-Za-z0-9_]*)"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(strip_code_comments(text), F.lit(head), F.lit(1))))


def c_literal(value: Column) -> Column:
    """A C integer literal as a decimal bigint: hex, binary, octal, decimal, suffixes ignored; else null."""
    v = F.lower(F.regexp_replace(F.trim(value), r"(?i)(?<=[0-9a-f])[ul]+$", ""))
    sign = F.when(F.startswith(v, F.lit("-")), -1).otherwise(1)
    d = F.regexp_replace(v, "^[-+]", "")
    number = (
        F.when(d.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substr(d, F.lit(3)), 16, 10))
        .when(d.rlike("^0b[01]{1,62}$"), F.conv(F.substr(d, F.lit(3)), 2, 10))
        .when(d.rlike("^0[0-7]{1,20}$"), F.conv(d, 8, 10))
        .when(d.rlike("^(0|[1-9][0-9]{0,17})$"), d)
    )
    return number.cast("bigint") * sign


def literal_type(value: Column) -> Column:
    """The Rust type of a C literal, by suffix and width."""
    v = F.lower(F.trim(value))
    digits, suffix = r"^[-+]?(0x[0-9a-f]+|0b[01]+|[0-9]+)([ul]*)$", F.regexp_extract(v, "([ul]*)$", 1)
    wide = F.when(F.contains(suffix, F.lit("l")), F.when(F.contains(suffix, F.lit("u")), "u64").otherwise("i64")).when(F.contains(suffix, F.lit("u")), "u32")
    bare = F.when(v.rlike("^[-+]?0x[0-9a-f]{9,}"), "u64").when(v.rlike("^-?0[xb]"), "u32").otherwise("i32")
    text = v.rlike('(?s)^".*"$') & (F.length(v) >= 2)
    return F.when(v.rlike(digits), F.coalesce(wide, bare)).when(text, "&'static [u8]").otherwise("u32")


def c_type_to_rust(text: Column) -> Column:
    """Qualifiers dropped, the type looked up; each * makes it a raw pointer; unknown types stay."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\b(const|volatile|static|extern|register|struct|enum)\b", " "), r"\*", " "), r"\s+", " "))
    depth = F.length(text) - F.length(F.replace(text, F.lit("*"), F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in C_TYPES.items() for x in kv])
    return F.concat(F.repeat(F.lit("*mut "), depth), F.coalesce(known[bare], bare))


def defines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, name, value, number, type): object-like #define lines; macros with parameters and reserved words are left out."""
    lines = df.select(id_col, F.explode(F.split(strip_comments(F.col(text)), "\n", -1)).alias("l"))
    got = lines.select(id_col, F.regexp_extract("l", r"^\s*#\s*define\s+([A-Za-z_]\w*)(?:\s+(.*))?$", 1).alias("name"), F.trim(F.regexp_extract("l", r"^\s*#\s*define\s+([A-Za-z_]\w*)(?:\s+(.*))?$", 2)).alias("value"), "l")
    got = got.where((F.col("name") != "") & ~F.col("l").rlike(r"#\s*define\s+\w+\(") & (F.col("value") != "") & ~F.col("value").isin("static", "extern", "const", "inline", "volatile"))
    return got.select(id_col, "name", "value", c_literal(F.col("value")).alias("number"), literal_type(F.col("value")).alias("type"))


def numbered_lines(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "snippet")).withColumn("line", F.col("line") + 1)


def find_unsafe(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line, snippet): lines with an unsafe block, outside strings and comments."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r'"(?:[^"\\\n]|\\.)*"', '""'), r"(?s)/\*.*?\*/", " ")
    lines = numbered_lines(df.withColumn("_clean", clean), [id_col], "_clean")
    return lines.where(F.regexp_replace("snippet", r"//.*$", "").rlike(r"\bunsafe\s*\{")).select(id_col, "line", F.trim("snippet").alias("snippet"))


def error_blocks(lines: DataFrame, group: str, position: str, text: str, chunk: int = 100_000) -> DataFrame:
    """Blocks of a compiler log that start with error; those that start with warning are dropped. A block runs to the
    next start; blocks are numbered within each log by a running sum.

    A log is summed in chunks of positions, and a table with a row per chunk carries the sums on, so that a long log is as many tasks
    as it has chunks. A block is gathered whole, as it is one message.
    """
    from pyspark.sql import Window

    start = F.col(text).rlike(r"^(error|warning)")
    marked = lines.select(group, position, text, F.floor(F.col(position) / chunk).alias("_chunk"), F.when(start, 1).otherwise(0).alias("_start"))
    inside = Window.partitionBy(group, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(group, "_chunk").agg(F.sum("_start").alias("_n")).select(group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = marked.withColumn("_own", F.sum("_start").over(inside)).join(carried, [group, "_chunk"]).withColumn("block", F.col("_own") + F.col("_before"))
    blocks = numbered.where("block > 0").groupBy(group, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text]), "\n").alias("message"))
    return blocks.where(F.startswith("message", F.lit("error")))


def glob_to_regex(pattern: str) -> str:
    """** crosses folders, * and ? don't; a bare file name fits in any folder."""
    out = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern))
    return f"^{out}$" if "/" in pattern else f"(?:^|/){out}$"


def allowed(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_to_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def _skip(text: str, i: int) -> int:
    """Past a string, character or comment that starts at i, else i."""
    if text.startswith("//", i):
        end = text.find("\n", i)
        return len(text) if end < 0 else end
    if text.startswith("/*", i):
        end = text.find("*/", i + 2)
        return len(text) if end < 0 else end + 2
    if text[i] == '"' or (text[i] == "'" and re.match(r"'(?:\\.|[^'\\])'", text[i : i + 4])):
        j = i + 1
        while j < len(text) and text[j] != text[i]:
            j += 2 if text[j] == "\\" else 1
        return j + 1
    return i


def matching_brace(text: str, at: int) -> int:
    """Place of the brace that closes the one at `at`, strings and comments skipped; -1 if none."""
    depth, i = 0, at
    while i < len(text):
        j = _skip(text, i)
        if j > i:
            i = j
            continue
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return i
        i += 1
    return -1


def split_top_level(text: str) -> list[str]:
    """Parts between commas outside of brackets, strings and comments."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(text):
        j = _skip(text, i)
        if j > i:
            i = j
            continue
        depth += {c: 1 for c in "([{<"}.get(text[i], 0) - {c: 1 for c in ")]}>"}.get(text[i], 0)
        if text[i] == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
        i += 1
    return [p for p in [*parts, text[start:].strip()] if p]


FUNCTIONS = "path string, name string, return_type string, params array<string>, calls array<string>, start_line int, end_line int, line_count int, is_static boolean, is_inline boolean"
_C_FUNCTION = re.compile(r"^((?:[A-Za-z_][\w]*[\s*]+)+?)([A-Za-z_]\w*)\s*\(([^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*\{", re.M)


def c_functions(files: DataFrame) -> DataFrame:
    """Function rows from files (path, text): a light scanner of C definitions, with the names that each body calls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                text = text or ""
                for m in _C_FUNCTION.finditer(text):
                    open_ = m.end() - 1
                    close = matching_brace(text, open_)
                    if m[2] in C_WORDS or close < 0:
                        continue
                    body = re.sub(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\]|\\.)*\"", " ", text[open_:close], flags=re.S)
                    calls = sorted({c for c in re.findall(r"\b([A-Za-z_]\w*)\s*\(", body) if c not in C_WORDS})
                    words = m[1].split()
                    a, b = text.count("\n", 0, m.start(2)) + 1, text.count("\n", 0, close) + 1
                    kind = " ".join(w for w in words if w not in ("static", "inline", "extern"))
                    params = [p for p in split_top_level(m[3]) if p != "void"]
                    out.append((path, m[2], kind, params, calls, a, b, b - a + 1, "static" in words, "inline" in words))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FUNCTIONS.split(", ")])

    return files.select("path", "text").mapInPandas(run, FUNCTIONS)


def call_edges(functions: DataFrame) -> DataFrame:
    """(src, dst): calls, distinct, external ones too."""
    return functions.select(F.col("name").alias("src"), F.explode("calls").alias("dst")).distinct()
