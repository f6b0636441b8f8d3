"""Keyword scores, ordered rules and text shape measures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A class of function: words of its name, of what it calls and of its variables."""

    name: str
    category: str
    confidence: float
    names: tuple[str, ...]
    calls: tuple[str, ...] = field(default=())
    variables: tuple[str, ...] = field(default=())


def first_rule(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def keyword_score(df: DataFrame, patterns: list[Pattern], name: str, calls: str, variables: str, least: float = 0.3) -> DataFrame:
    """df with pattern, category, score: confidence if a word is in the name, 0.15 more if it is in a call,
    0.2 (two or more) or 0.1 (one) for variables; the best pattern wins, the first on ties; below `least` it is glue at 0.1.

    Patterns are literals of the plan, so rows are scored where they are.
    """
    has = lambda text, words: F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False)) if words else F.lit(False)

    def score(p: Pattern) -> Column:
        hits = F.size(F.filter(F.coalesce(F.col(variables), F.array().cast("array<string>")), lambda v: F.lower(v).isin(*p.variables))) if p.variables else F.lit(0)
        return (
            F.when(has(F.col(name), p.names), p.confidence).otherwise(0.0)
            + F.when(has(F.array_join(F.col(calls), " "), p.calls), 0.15).otherwise(0.0)
            + F.when(hits >= 2, 0.2).when(hits == 1, 0.1).otherwise(0.0)
        )

    scored = df.withColumn("_s", F.array(*[F.struct(F.round(score(p), 6).alias("score"), F.lit(-i).alias("at"), F.lit(p.name).alias("pattern"), F.lit(p.category).alias("category")) for i, p in enumerate(patterns)]))
    best = F.array_max("_s")
    sure = best["score"] >= least
    return scored.select(*df.columns, F.when(sure, best["pattern"]).alias("pattern"), F.when(sure, best["category"]).otherwise("glue").alias("category"), F.when(sure, best["score"]).otherwise(0.1).alias("score"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_metrics(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, n_lines, n_filled, n_code, n_distinct): lines, lines that aren't blank, of these those that don't start
    with //, and different lines."""
    l = lines_of(F.col(text))  # noqa: E741
    # a column of its own, or each measure would split the text again
    rows = df.select(id_col, l.alias("_l"))
    filled = F.filter("_l", lambda x: F.trim(x) != "")
    code = F.filter(filled, lambda x: ~F.startswith(F.trim(x), F.lit("//")))
    measures = {"n_lines": F.col("_l"), "n_filled": filled, "n_code": code, "n_distinct": F.array_distinct("_l")}
    return rows.select(id_col, *[F.size(x).cast("bigint").alias(n) for n, x in measures.items()])


def degenerate(df: DataFrame, id_col: str, text: str, least_chars: int = 500, least_repeats: int = 10, share: float = 0.3) -> DataFrame:
    """(id, top, filled): texts of `least_chars` or more whose most frequent line stands at least `least_repeats` times and
    makes up more than `share` of the lines that aren't blank. Trimmed lines are counted."""
    rows = df.where(F.length(text) >= least_chars).select(id_col, F.explode(lines_of(F.col(text))).alias("line")).select(id_col, F.trim("line").alias("line")).where("line <> ''")
    counts = rows.groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy(id_col).agg(F.max("n").alias("top"), F.sum("n").alias("filled"))
    return tops.where((F.col("top") >= least_repeats) & (F.col("top") > F.col("filled") * share))


def grade(errors: Column, warnings: Column, unsafe: Column) -> Column:
    """A without any of the three, B without errors and unsafe, C without errors, else D."""
    return first_rule([((errors == 0) & (warnings == 0) & (unsafe == 0), "A"), ((errors == 0) & (unsafe == 0), "B"), (errors == 0, "C")], "D")


def test_counts(text: Column) -> Column:
    """struct<passed, failed>: sums over all "N passed; M failed" of a log."""
    total = lambda word: F.aggregate(F.regexp_extract_all(text, F.lit(rf"(\d+) {word}"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return F.struct(total("passed").alias("passed"), total("failed").alias("failed"))
