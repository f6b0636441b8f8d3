"""Checks of a module layout held in tables, as one issues table (rule, severity, location, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import strong_components
from .relational import union_findings


def _issues(rows: DataFrame, rule: str, severity: str, location: Column, message: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), location.cast("string").alias("location"), F.lit(message).alias("message"))


def dependency_edges(crates: DataFrame) -> DataFrame:
    """(src, dst): what is needed and who needs it; dependencies outside the table are left out."""
    edges = crates.select(F.explode("dependencies").alias("src"), F.col("name").alias("dst"))
    return edges.join(crates.select(F.col("name").alias("src")), "src", "left_semi")


def cycles(crates: DataFrame) -> DataFrame:
    found = strong_components(dependency_edges(crates)).groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("node")), ", ").alias("names"))
    return _issues(found, "dependency_dag", "error", F.col("names"), "dependencies form a cycle")


def missing_producers(crates: DataFrame, errors: DataFrame) -> DataFrame:
    """Error types (name, crate) of crates that don't exist."""
    lost = errors.join(crates.select(F.col("name").alias("crate")), "crate", "left_anti")
    return _issues(lost, "missing_producer", "error", F.col("name"), "the crate of an error type doesn't exist")


def empty_crates(crates: DataFrame) -> DataFrame:
    return _issues(crates.where((F.size("modules") <= 0) & (F.size("public_api") <= 0)), "empty_crate", "warning", F.col("name"), "neither modules nor public names")


def naming(crates: DataFrame, workspace: str) -> DataFrame:
    return _issues(crates.where(~F.startswith("name", F.lit(workspace))), "workspace_naming", "info", F.col("name"), "the workspace's name is no prefix")


def name_collisions(crates: DataFrame, workspace: str) -> DataFrame:
    """Crates whose name without the workspace's is another crate's."""
    plain = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    short = crates.select("name", plain(F.replace("name", F.lit(f"{workspace}-"), F.lit(""))).alias("short"))
    taken = crates.select(plain(F.col("name")).alias("short"))
    return _issues(short.where(F.col("short") != plain(F.col("name"))).join(taken, "short", "left_semi"), "module_name_collision", "warning", F.col("name"), "the short name is another crate's")


def error_types_per_crate(crates: DataFrame, errors: DataFrame) -> DataFrame:
    bare = crates.where(F.size("modules") >= 2).join(errors.select(F.col("crate").alias("name")), "name", "left_anti")
    return _issues(bare, "per_crate_error_missing", "warning", F.col("name"), "two or more modules and no error type")


def module_assignment(crates: DataFrame) -> DataFrame:
    """Modules that more than one crate lists."""
    twice = crates.select("name", F.explode("modules").alias("module")).groupBy("module").agg(F.count_distinct("name").alias("n")).where("n > 1")
    return _issues(twice, "module_multi_assigned", "error", F.col("module"), "more than one crate has this module")


def coverage(crates: DataFrame, specs: DataFrame, exempt: tuple[str, ...] = ("error", "types", "utils", "lib")) -> DataFrame:
    """Modules that no spec (module, algorithm) knows, and specs that no crate has."""
    listed = crates.select(F.explode("modules").alias("module")).distinct()
    known = specs.select("module").unionByName(specs.select(F.col("algorithm").alias("module"))).distinct()
    unknown = listed.join(known, "module", "left_anti").where(~F.col("module").isin(*exempt))
    by_part = specs.join(listed.select(F.col("module").alias("algorithm")), "algorithm", "left_semi").select("module")
    lost = specs.select("module").distinct().join(listed, "module", "left_anti").join(by_part, "module", "left_anti")
    return _issues(unknown, "unknown_module", "error", F.col("module"), "no spec has this name").unionByName(_issues(lost, "spec_unassigned", "error", F.col("module"), "no crate has this spec"))


def large_states(types: DataFrame, wrappers: DataFrame, most: int = 10) -> DataFrame:
    """Types (name, fields array) with more than `most` fields and no wrapper (inner_state)."""
    bare = types.where(F.size("fields") > most).join(wrappers.select(F.col("inner_state").alias("name")), "name", "left_anti")
    return _issues(bare, "state_wrapper_missing", "error", F.col("name"), "many fields and no wrapper")


def parameterized_inits(functions: DataFrame, builders: DataFrame) -> DataFrame:
    """Init functions (name, inputs array<struct<name, type>>) of two or more inputs beside streams and states, whose
    type no builder (built_type) makes."""
    pattern = r"[Ii]nit\d*_?$"
    own = F.filter("inputs", lambda p: ~p["type"].rlike("Stream|State"))
    many = functions.where(F.col("name").rlike(pattern) & (F.size(own) > 1)).withColumn("built_type", F.initcap(F.trim(F.lit("_"), F.regexp_replace("name", pattern, ""))))
    return _issues(many.where("built_type <> ''").join(builders.select("built_type"), "built_type", "left_anti"), "builder_missing", "warning", F.col("name"), "several inputs and no builder")


def validate(crates: DataFrame, errors: DataFrame, specs: DataFrame, workspace: str) -> DataFrame:
    return union_findings([cycles(crates), missing_producers(crates, errors), empty_crates(crates), naming(crates, workspace), name_collisions(crates, workspace), error_types_per_crate(crates, errors), module_assignment(crates), coverage(crates, specs)])
