"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded blocks of each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._staging import staged

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def apportion(rows: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Adds quota (long): the Sainte-Lague share of each row in the `seats` of its group, by `votes`.

    The rule gives seats to the highest quotients votes / (2k + 1), k = 0, 1, ... With V votes, S seats and n rows in
    a group, the divisor at which the seats add up lies between V / (S + n/2) and V / (S - n/2), so row i is sure of
    floor(votes (S - n/2) / V + 1/2) seats and can't have more than the same with S + n/2. Only the quotients between
    these, about two a row, are ranked; ties go to the smaller key. A group without votes has no seats.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    s, v = F.col(seats).cast("double"), F.col(votes).cast("double")
    base = rows.withColumn("_all", F.sum(v).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    at = lambda more: F.greatest(F.lit(0).cast("long"), F.floor(v * (s + more) / F.col("_all") + 0.5).cast("long"))
    none = (F.col("_all") <= 0) | F.col("_all").isNull()
    base = base.withColumn("_low", F.when(none, 0).otherwise(at(-F.col("_n") / 2))).withColumn("_high", F.when(none, 0).otherwise(at(F.col("_n") / 2) + 1))
    base = base.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    tries = base.withColumn("_k", F.explode(F.expr("sequence(_low, _high)")))
    ranked = tries.withColumn("_rank", F.row_number().over(whole.orderBy((v / (2 * F.col("_k") + 1)).desc(), F.col(key), F.col("_k"))))
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & ~none, 1).otherwise(0))
    kept = [F.col(c) for c in rows.columns]
    return ranked.groupBy(*kept, "_low").agg(won.alias("_won")).select(*kept, (F.col("_low") + F.col("_won")).cast("long").alias("quota"))


def mix_targets(sources: DataFrame, total_share: float, weights: list[float], cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Weights repeat over the sources by code point, null last. Targets share total_share of all sizes by weight, but
    stop at cap times a source's size; the excess is shared again by weight until no target is above. That is
    target = min(cap * size, weight * level); the level is found from sums alone, so nothing but one row per round
    reaches the driver, however many sources there are.
    """
    # UTF-8 order is code point order
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    placed = sources.withColumn("_at", F.row_number().over(order) - 1)
    placed = placed.withColumn("weight", F.element_at(pattern, (F.col("_at") % len(weights) + 1).cast("int"))).drop("_at")
    placed = staged(placed, "sources")
    top = F.col("source_size") * F.lit(float(cap))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    budget, level = total * total_share, 0.0
    while True:
        full = top <= F.col("weight") * F.lit(level)
        taken, open_weight = placed.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        risen = (budget - (taken or 0.0)) / open_weight
        if risen <= level:
            break
        level = risen
    return placed.withColumn("target", F.least(top, F.col("weight") * F.lit(level)))


def mix_sources(
    docs: DataFrame,
    weights: list[float],
    total_share: float = 1.5,
    cap: float = 2.0,
    block: int = 64,
    docs_per_shard: int = 1024,
    seed: int = 0,
    id_col: str = "doc_id",
) -> DataFrame:
    """How many words of each document a mix takes: id, source, size, source_size, target, shard, taken.

    1. Targets by mix_targets. 2. The mix has round(sum of targets / block) blocks of `block` words; Sainte-Lague
    gives each source its blocks by target. 3. A source's documents fall into shards by a seeded hash of the id, about
    docs_per_shard in each, so a source with a third of all rows is many shards; Sainte-Lague gives each shard its
    blocks by size. 4. In a shard, documents stand in the order of a seeded hash; as many whole passes as the quota
    holds take every document, then the first blocks in that order make up the rest. No document is taken more
    than cap (a whole number) times.

    Null text has size 0 and is never taken. A null source is a source of its own, the last. Repeated rows count each
    for itself. Equal input and seed give equal output in whatever order rows come. An empty table gives no rows.
    """
    mark = lambda salt: F.xxhash64(F.lit(f"{seed}/{salt}"), F.col(id_col))
    sized = staged(docs.select(F.col(id_col), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    targets = mix_targets(sources, total_share, weights, cap)
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    blocks = targets.agg(F.round(F.coalesce(F.sum("target"), F.lit(0.0)) / block).cast("long")).first()[0]
    targets = apportion(targets.withColumn("_key", key).withColumn("_seats", F.lit(blocks)), [], "_key", "target", "_seats")
    targets = staged(targets.withColumn("_shards", F.ceil(F.col("_docs") / docs_per_shard)).withColumnRenamed("quota", "_blocks").drop("_seats", "_docs"), "targets")

    t = targets.withColumnRenamed("source", "_source")
    placed = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(mark("shard"), F.col("_shards")))
    shards = placed.groupBy("_key", "shard").agg(F.sum("size").alias("_shard_size"), F.first("_blocks").alias("_seats"))
    quotas = staged(apportion(shards, ["_key"], "shard", "_shard_size", "_seats").drop("_seats"), "quotas")

    line = Window.partitionBy("_key", "shard").orderBy(mark("order"), F.col(id_col), F.col("size"))
    before = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    laid = placed.withColumn("_before", before).join(quotas, ["_key", "shard"])
    words = F.least(F.col("quota") * block, F.col("_shard_size") * int(cap))
    passes = F.floor(words / F.greatest(F.col("_shard_size"), F.lit(1))).cast("long")
    rest = words - passes * F.col("_shard_size")
    taken = passes * F.col("size") + F.least(F.greatest(rest - F.col("_before"), F.lit(0)), F.col("size"))
    return laid.select(id_col, "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken"))
