"""Variants of algorithms, told by fingerprints in their descriptions and by test vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_hex(value: Column) -> Column:
    """Lower case, without 0x and leading zeros; blank if it isn't hex."""
    bare = F.regexp_replace(F.lower(F.trim(value)), "^0x", "")
    return F.when(bare.rlike("^[0-9a-f]+$"), F.regexp_replace(bare, "^0+(?=.)", "")).otherwise("")


def resolve(algorithms: DataFrame, variants: DataFrame, vectors: DataFrame, catalog: DataFrame, most_families: int = 1_000) -> DataFrame:
    """(name, family, chosen, candidates, rationale) from algorithms (name, text), variants (family, family_pattern, variant,
    position, fingerprints array, catalog), vectors (name, input, expected) and catalog (catalog, input, expected).

    The first family whose pattern is in the name holds. Its variants with a fingerprint in the text are candidates;
    without any, the only variant of a family is taken. Several are narrowed to those that agree with the catalogue on
    the inputs that both have, or else by leaving out those that disagree, if that leaves any. Names are distinct.

    Families are few, at most most_families, and their patterns become one expression: no join by pattern. All else is
    joined by name, family or vector, however many algorithms, vectors or catalogue rows there are.
    """
    families = variants.groupBy("family", "family_pattern").agg(F.min("position").alias("at"), F.count(F.lit(1)).alias("n_variants"))
    known = families.orderBy("at", "family").limit(most_families + 1).collect()
    if len(known) > most_families:
        raise ValueError(f"more than {most_families} families of variants")
    none = F.lit(None).cast("struct<family:string,n_variants:bigint>")
    first = F.coalesce(*[F.when(F.rlike(F.lower("name"), F.lit(r.family_pattern)), F.struct(F.lit(r.family).alias("family"), F.lit(r.n_variants).cast("bigint").alias("n_variants"))) for r in known], none)
    of = algorithms.select("name", "text", first.alias("_f")).select("name", "text", "_f.family", "_f.n_variants")
    tried = of.join(variants.select("family", "variant", "position", "fingerprints", "catalog"), "family")
    hit = tried.withColumn("hit", F.exists("fingerprints", lambda f: F.contains(F.lower("text"), F.lower(f))))
    alone = hit.groupBy("name").agg(F.max(F.col("hit").cast("int")).alias("any"))
    hit = hit.join(alone, "name").where((F.col("hit")) | ((F.col("any") == 0) & (F.col("n_variants") == 1)))
    said = vectors.select("name", plain_hex(F.col("input")).alias("input"), plain_hex(F.col("expected")).alias("said"))
    known = catalog.select("catalog", plain_hex(F.col("input")).alias("input"), plain_hex(F.col("expected")).alias("known"))
    votes = hit.join(said, "name").join(known, ["catalog", "input"]).groupBy("name", "variant").agg(F.bool_and(F.col("said") == F.col("known")).alias("agrees"))
    judged = hit.join(votes, ["name", "variant"], "left")
    best = judged.groupBy("name").agg(F.max(F.when(F.col("agrees"), 2).when(F.col("agrees").isNull(), 1).otherwise(0)).alias("best"))
    kept = judged.join(best, "name").where(F.when(F.col("agrees"), 2).when(F.col("agrees").isNull(), 1).otherwise(0) == F.col("best"))
    lists = kept.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "variant"))), lambda x: x["variant"]).alias("candidates"))
    out = of.join(lists, "name", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    n = F.size("candidates")
    why = F.when(F.col("family").isNull(), "no family").when(n == 0, "no fingerprint").when(n == 1, "one candidate").otherwise("ambiguous")
    return out.select("name", "family", F.when(n == 1, F.get("candidates", F.lit(0))).alias("chosen"), "candidates", why.alias("rationale"))
