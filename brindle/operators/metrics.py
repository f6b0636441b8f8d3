"""Metrics of a code base from one scan of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Forms of unsafe code.
UNSAFE = (r"\bunsafe\s*\{", r"\bunsafe\s+fn\b", r"\bunsafe\s+impl\b")


def line_counts(text: Column) -> Column:
    """struct<n_lines, code_lines>: all lines, and those that are neither blank nor a // comment."""
    lines = F.split(text, "\n", -1)
    code = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("//")))
    return F.struct(F.size(lines).cast("bigint").alias("n_lines"), F.size(code).cast("bigint").alias("code_lines"))


def file_metrics(files: DataFrame) -> DataFrame:
    """(kind, crate, path, n_lines, code_lines, unsafe_blocks) of files (kind, crate, path, text); a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unsafe = sum((F.regexp_count(text, F.lit(p)) for p in UNSAFE), F.lit(0))
    return files.select("kind", "crate", "path", line_counts(text).alias("_n"), unsafe.cast("bigint").alias("unsafe_blocks")).select("kind", "crate", "path", "_n.*", "unsafe_blocks")


def collect_metrics(files: DataFrame, observed: Observation | None = None) -> DataFrame:
    """(kind, crate, files, n_lines, code_lines, unsafe_blocks, files_with_unsafe): sums by crate, by kind (crate null) and
    over all (both null), crate_level and kind_level telling sums from null names.

    One scan: the three levels are grouping sets of one aggregate, which is combined before the shuffle. `observed`
    gets the totals (files, n_lines, unsafe_blocks) of the same pass, when the result is computed.
    """
    each = file_metrics(files)
    if observed is not None:
        each = each.observe(observed, F.count(F.lit(1)).alias("files"), F.sum("n_lines").alias("n_lines"), F.sum("unsafe_blocks").alias("unsafe_blocks"))
    sums = [F.count(F.lit(1)).alias("files"), *(F.sum(c).alias(c) for c in ("n_lines", "code_lines", "unsafe_blocks")), F.count_if(F.col("unsafe_blocks") > 0).alias("files_with_unsafe")]
    levels = each.groupingSets([[F.col("kind"), F.col("crate")], [F.col("kind")], []], F.col("kind"), F.col("crate"))
    return levels.agg(F.grouping("kind").cast("int").alias("kind_level"), F.grouping("crate").cast("int").alias("crate_level"), *sums)


def summarize(metrics: DataFrame, code: str = "rust", source: str = "c") -> DataFrame:
    """One row from collect_metrics: unsafe_blocks, code files, lines and crates, source lines, and lines of code per line of
    source."""
    kind = lambda k, level, c: F.sum(F.when((F.col("kind") == k) & (F.col("kind_level") == 0) & (F.col("crate_level") == level), F.col(c)))
    row = metrics.agg(
        F.coalesce(kind(code, 1, "unsafe_blocks"), F.lit(0)).alias("unsafe_blocks"), F.coalesce(kind(code, 1, "files"), F.lit(0)).alias("files"), F.coalesce(kind(code, 1, "n_lines"), F.lit(0)).alias("n_lines"),
        F.count_if((F.col("kind") == code) & (F.col("crate_level") == 0) & F.col("crate").isNotNull()).alias("crates"), F.coalesce(kind(source, 1, "n_lines"), F.lit(0)).alias("source_lines"),
    )
    return row.withColumn("loc_ratio", F.col("n_lines") / F.greatest("source_lines", F.lit(1)))
