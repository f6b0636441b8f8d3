"""Compiler errors about types of other crates, where those types are defined, and what to move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.intervals import enclosing

#: How many lines of a log belong to an error, its own among them.
REACH = 10
_LOCATION = r"-->\s+([^\s:]+):([0-9]+):[0-9]+"
_IMPL = r"impl\s+(?:<[^>]+>\s+)?(\w+)"
_DEFINED = r"^\s*pub\s+(?:struct|enum|type|union)\s+([A-Za-z_]\w*)"


def orphan_errors(lines: DataFrame, root: str = "") -> DataFrame:
    """(log, line, type_name, impl_file, impl_crate) of logs (log, line, text): one row per error[E0116] whose next lines
    name a type after `impl`. file and crate come from the first place that those lines give, the crate being the file's
    first folder below root, else its first folder at all; both empty without a place.

    Each error asks for its REACH lines by number, which say something: an equi-join, so a log of any length is spread over all tasks.
    They are sorted and merged: the optimizer counts none of the rows that either side is exploded to, and would send them to all.
    """
    heads = lines.where(F.contains("text", F.lit("error[E0116]"))).select("log", F.col("line").alias("head"))
    asked = heads.withColumn("line", F.explode(F.sequence("head", F.col("head") + (REACH - 1))))
    telling = lines.where(F.col("text").rlike(_IMPL) | F.col("text").rlike(_LOCATION)).select("log", "line", "text")
    near = asked.hint("merge").join(telling, ["log", "line"])
    first = lambda pattern: F.min_by(F.regexp_extract("text", pattern, 1), F.when(F.col("text").rlike(pattern), F.col("line")))
    found = near.groupBy("log", "head").agg(first(_IMPL).alias("type_name"), first(_LOCATION).alias("impl_file")).where("type_name is not null")
    file = F.coalesce("impl_file", F.lit(""))
    below = F.when(F.lit(bool(root)) & F.startswith(file, F.lit(root.rstrip("/") + "/")), F.substr(file, F.lit(len(root.rstrip("/")) + 2))).otherwise(F.regexp_replace(file, "^/", ""))
    return found.select("log", F.col("head").alias("line"), "type_name", file.alias("impl_file"), F.split(below, "/")[0].alias("impl_crate"))


def type_definitions(files: DataFrame) -> DataFrame:
    """(type_name, crate, path, line): public types of files (crate, path, text); of a type with several definitions the
    first in order of crate, path and line. Folders named target hold none."""
    rows = files.where("crate <> 'target' and path like '%.rs'").select("crate", "path", F.posexplode(F.split("text", "\n", -1)).alias("line", "code"))
    found = rows.select("crate", "path", (F.col("line") + 1).alias("line"), F.regexp_extract("code", _DEFINED, 1).alias("type_name")).where("type_name <> ''")
    return found.groupBy("type_name").agg(F.min(F.struct("crate", "path", "line")).alias("d")).select("type_name", "d.*")


def relocations(errors: DataFrame, definitions: DataFrame) -> DataFrame:
    """(log, line, type_name, from_crate, to_crate, reason) of errors whose type is defined in another crate."""
    moved = errors.join(definitions.select("type_name", F.col("crate").alias("from_crate")), "type_name").where("from_crate <> impl_crate")
    why = F.concat(F.lit("E0116: "), "impl_crate", F.lit(" tries to impl "), "type_name", F.lit(" but it's defined in "), "from_crate")
    return moved.select("log", "line", "type_name", "from_crate", F.col("impl_crate").alias("to_crate"), why.alias("reason"))


def places_in_definitions(places: DataFrame, definitions: DataFrame, at: str = "line") -> DataFrame:
    """places (path, line, ...) with the innermost of definitions (path, name, start, end) that each stands in."""
    return enclosing(places, definitions.select("path", "start", "end", "name"), ["path"], at).drop("start", "end")


def summary(proposed: DataFrame) -> Column:
    return F.when(F.count(F.lit(1)) == 0, "no refactoring needed").otherwise(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" type relocation(s) proposed")))
