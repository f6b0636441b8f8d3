"""Joins, set relations, aggregation and ranking over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, change): added, deleted or modified (the digest differs); what is the same is left out."""
    a, b = old.select(key, F.col(digest).alias("_old"), F.lit(1).alias("_a")), new.select(key, F.col(digest).alias("_new"), F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def invalidated(changes: DataFrame, owners: DataFrame, key: str = "path") -> DataFrame:
    """Rows of owners (key, ...) whose key is among the changes."""
    return owners.join(changes.select(key), key, "left_semi")


def missing(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows that nothing found covers."""
    return expected.join(found, on, "left_anti")


def snake(name: Column) -> Column:
    """Lower case, with _ where an upper-case letter follows a lower-case one or a digit; no _ twice or at the ends."""
    parted = F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))
    return F.btrim(F.regexp_replace(parted, "_+", "_"), F.lit("_"))


def name_variants(name: Column) -> Column:
    """A name, its snake form, and both without a leading z_ or Z_."""
    bare = lambda c: F.regexp_replace(c, "^[zZ]_", "")
    return F.array_distinct(F.array(name, snake(name), bare(name), snake(bare(name))))


def missing_names(expected: DataFrame, found: DataFrame, name: str = "name") -> DataFrame:
    """Expected names of which no variant is found."""
    tried = expected.withColumn("_v", F.explode(name_variants(F.col(name))))
    hit = tried.join(found.select(F.col(name).alias("_v")), "_v", "left_semi").select(*expected.columns).distinct()
    return expected.join(hit, expected.columns, "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first by order. Spark limits each group to a row before the shuffle too, so a hot key
    sends one row a task."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row of each key, the last by position; a grouped maximum, so a hot key is combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(position, *[c for c in others if c != position])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def alias_lookup(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """names with canonical: the alias equal to the lower-cased name, else to the name without blanks, hyphens and
    underscores, else the longest alias that the squashed name starts with.

    Prefixes of the squashed names are joined with the aliases by equality, one row for each alias length there is
    (at most as many as the longest alias has characters).
    """
    squash = lambda c: F.regexp_replace(F.lower(c), r"[\s_\-/]", "")
    table = aliases.select(F.lower("alias").alias("_alias"), "canonical")
    # distinct names only: a lookup key repeats in data
    sizes = sorted(r[0] for r in table.where("_alias <> ''").select(F.length("_alias")).distinct().collect())
    sizes = F.array(*[F.lit(n) for n in sizes]).cast("array<int>")
    distinct = names.select(name).distinct().where(F.col(name).isNotNull())
    tries = distinct.withColumn("_squashed", squash(F.col(name))).select(name, F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("less"), F.lower(name).alias("_alias")), F.struct(F.lit(1).alias("rank"), F.lit(0).alias("less"), squash(F.col(name)).alias("_alias"))),
        F.transform(F.filter(sizes, lambda n: n <= F.length(F.col("_squashed"))), lambda n: F.struct(F.lit(2).alias("rank"), (-n).alias("less"), F.substr(F.col("_squashed"), F.lit(1), n).alias("_alias"))),
    )).alias("t")).select(name, "t.*")
    best = tries.join(table, "_alias").groupBy(name).agg(F.min_by("canonical", F.struct("rank", "less", "canonical")).alias("canonical"))
    return names.join(best, name, "left")


def differences(rows: DataFrame, index: str, left: str, right: str, limit: int | None = None) -> DataFrame:
    """Rows whose two results differ, nulls compared as values; the first `limit` by index."""
    out = rows.where(~F.col(left).eqNullSafe(F.col(right)))
    return out.orderBy(index).limit(limit) if limit is not None else out


def comparison_gate(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(compared, differing, ok): an empty comparison is a failure."""
    differ = F.count_if(~F.col(left).eqNullSafe(F.col(right)))
    return rows.agg(F.count(F.lit(1)).alias("compared"), differ.alias("differing"), ((F.count(F.lit(1)) > 0) & (differ == 0)).alias("ok"))


def fold_mismatches(vectors: DataFrame, mismatches: DataFrame, key: str, most: int = 5) -> DataFrame:
    """vectors with up to `most` mismatches whose key is not among them, first by idx."""
    new = mismatches.join(vectors.select(key), key, "left_anti").orderBy("idx").limit(most)
    return vectors.unionByName(new.select(*vectors.columns))


def best_of(df: DataFrame, keys: list[str], scores: list) -> DataFrame:
    """The best row of each key by the scores in order; `scores` are sort columns, the last ones breaking ties."""
    return keep_first(df, keys, scores)


def weighted_vote(votes: DataFrame, group: str, choice: str, weight: Column, position: str, bonus: Column | None = None) -> DataFrame:
    """(group, choice, weight, confidence): the choice of the greatest summed weight (ties: the smallest position), plus a
    bonus for each choice; confidence is the share of the group's rows that the weight makes up, at most 1."""
    sums = votes.groupBy(group, choice).agg((F.sum(weight) + (F.max(bonus) if bonus is not None else F.lit(0))).alias("weight"), F.min(position).alias("_at"), F.sum(weight).alias("_own"))
    whole = sums.groupBy(group).agg(F.max_by(F.struct(choice, "weight"), F.struct(F.col("weight"), -F.col("_at"))).alias("b"), F.sum("_own").alias("_all"))
    return whole.select(group, F.col(f"b.{choice}").alias(choice), F.col("b.weight").alias("weight"), F.least(F.col("b.weight") / (F.col("_all") + 1), F.lit(1.0)).alias("confidence"))


def gate_report(gates: DataFrame, group: list[str], name: str, ok: str, order: str) -> DataFrame:
    """(group, ok, first_failure): all gates passed, and the first that didn't in order; a null result is a failure."""
    bad = ~F.coalesce(F.col(ok), F.lit(False))
    return gates.groupBy(*group).agg((~F.bool_or(bad)).alias("ok"), F.min_by(name, F.when(bad, F.col(order))).alias("first_failure"))


def families(rows: DataFrame, shape: list[str], member: str, least: int = 2) -> DataFrame:
    """Groups of at least `least` members of one shape, members sorted."""
    return rows.groupBy(*shape).agg(F.array_sort(F.collect_set(member)).alias("members")).where(F.size("members") >= least)


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coupled_by_stem(sources: DataFrame, headers: DataFrame) -> DataFrame:
    """sources (path, stem) left-joined to headers (path, stem) whose stem is the same, <stem>_internal or <stem>s; as
    three equi-joins in one, by exploding the stems that fit."""
    tried = sources.withColumn("_s", F.explode(F.array("stem", F.concat("stem", F.lit("_internal")), F.concat("stem", F.lit("s")))))
    hit = tried.join(headers.select(F.col("stem").alias("_s"), F.col("path").alias("header")), "_s")
    return sources.join(hit.groupBy("path").agg(F.array_sort(F.collect_set("header")).alias("headers")), "path", "left")
