"""C headers: prototypes, enumerators, constant tables, and how declared signatures agree with specifications."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import keep_first
from .textscan import C_TYPES, _skip, c_literal, c_type_to_rust, matching_brace, split_top_level

PROTOTYPES = "path string, name string, return_type string, params array<struct<type:string,name:string>>, line int"
_PROTOTYPE = re.compile(r"^[ \t]*((?:[A-Za-z_]\w*[\s*]+)+?)\s*(\**[A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*;", re.M)


def without_comments(text: str) -> str:
    """Comments as blanks of the same length and lines, strings kept."""
    out, i = [], 0
    while i < len(text):
        j = _skip(text, i)
        if j > i:
            out.append(re.sub(r"[^\n]", " ", text[i:j]) if text[i] == "/" else text[i:j])
            i = j
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def _parameter(text: str) -> dict[str, str]:
    m = re.match(r"^(.*?[\s*])([A-Za-z_]\w*)\s*((?:\[[^\]]*\])*)$", text.strip(), re.S)
    if not m or m[2] in C_TYPES:
        return {"type": text.strip(), "name": ""}
    return {"type": m[1].strip() + ("*" if m[3] else ""), "name": m[2]}


def prototypes(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Function prototypes of headers (path, text); only: names to keep."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                clean = without_comments(text or "")
                for m in _PROTOTYPE.finditer(clean):
                    stars = len(m[2]) - len(m[2].lstrip("*"))
                    words = [w for w in m[1].split() if w not in ("extern", "static", "inline")]
                    params = [_parameter(p) for p in split_top_level(m[3]) if p != "void"]
                    if words and words[0] not in ("return", "typedef", "else"):
                        out.append((path, m[2].lstrip("*"), re.sub(r"\s*\*", "*", " ".join(words)) + "*" * stars, params, clean.count("\n", 0, m.start(2)) + 1))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ("path", "name", "return_type", "params", "line")])

    found = files.select("path", "text").mapInPandas(run, PROTOTYPES)
    return found.where(F.col("name").isin(*only)) if only else found


ENUMERATORS = "path string, enum string, name string, value string, position int"


def enumerators(files: DataFrame) -> DataFrame:
    """(path, enum, name, number): explicit numbers, and one more than the one before from there on; null after a value
    that is no literal."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                clean = without_comments(text or "")
                for m in re.finditer(r"\benum\s*([A-Za-z_]\w*)?\s*\{", clean):
                    close = matching_brace(clean, m.end() - 1)
                    for k, part in enumerate(split_top_level(clean[m.end() : close]) if close > 0 else ()):
                        name, _, value = part.partition("=")
                        out.append((path, m[1] or "", name.strip(), value.strip() or None, k))
            yield pd.DataFrame(out, columns=["path", "enum", "name", "value", "position"])

    from pyspark.sql import Window

    rows = files.select("path", "text").mapInPandas(run, ENUMERATORS)
    line = Window.partitionBy("path", "enum").orderBy("position")
    start = F.last(F.when(F.col("value").isNotNull() | (F.col("position") == 0), F.struct(F.when(F.col("value").isNull(), F.lit(0).cast("bigint")).otherwise(c_literal(F.col("value"))).alias("n"), F.col("position").alias("p"))), ignorenulls=True).over(line)
    return rows.withColumn("_s", start).select("path", "enum", "name", (F.col("_s.n") + F.col("position") - F.col("_s.p")).alias("number"))


TABLES = "path string, name string, type string, length int, values array<string>"


def constant_tables(files: DataFrame) -> DataFrame:
    """(path, name, type, length, values): static const arrays, nested braces flattened in order."""

    def flat(text: str) -> list[str]:
        return [v for p in split_top_level(text) for v in (flat(p[1 : matching_brace(p, 0)]) if p.startswith("{") else [p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                clean = without_comments(text or "")
                for m in re.finditer(r"\b(?:static\s+const|const\s+static|const)\s+([A-Za-z_][\w\s]*?)\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])+\s*=\s*\{", clean):
                    close = matching_brace(clean, m.end() - 1)
                    if close > 0:
                        values = flat(clean[m.end() : close])
                        out.append((path, m[2], m[1].strip(), len(values), values))
            yield pd.DataFrame(out, columns=["path", "name", "type", "length", "values"])

    return files.select("path", "text").mapInPandas(run, TABLES)


def audit_signatures(specs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(name, rule, severity, message) from specs (name, return_type, inputs array<struct<name, type>>) and C signatures
    (path, name, return_type, params): functions without one, other numbers of parameters, other return types. The first
    signature of a name, by path, holds."""
    first = keep_first(signatures, ["name"], ["path", "line"]).select("name", F.size("params").alias("_n"), c_type_to_rust(F.col("return_type")).alias("_r"), F.lit(True).alias("_c"))
    both = specs.join(first, "name", "left")
    n = F.size("inputs")
    issue = lambda when, rule, severity, message: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message")))
    found = F.array(
        issue(F.col("_c").isNull(), "missing_c_function", "warning", F.lit("no C function of this name")),
        issue(F.col("_c") & (n != F.col("_n")), "parameter_count", "error", F.format_string("%d inputs, %d C parameters", n, F.col("_n"))),
        issue(F.col("_c") & (F.col("return_type") != F.col("_r")), "return_type", "error", F.format_string("%s, but C says %s", "return_type", "_r")),
    )
    return both.select("name", F.explode(F.array_compact(found)).alias("f")).select("name", "f.*")


def apply_return_fixes(specs: DataFrame, findings: DataFrame, signatures: DataFrame) -> DataFrame:
    """specs with the C return type where a return_type finding says so."""
    wrong = findings.where("rule = 'return_type'").select("name").distinct()
    first = keep_first(signatures, ["name"], ["path", "line"]).select("name", c_type_to_rust(F.col("return_type")).alias("_fix")).join(wrong, "name", "left_semi")
    return specs.join(first, "name", "left").withColumn("return_type", F.coalesce("_fix", "return_type")).drop("_fix")
