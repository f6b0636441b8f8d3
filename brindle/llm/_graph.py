"""Connected components by alternating stars, as joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._staging import staged


def _relink(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(lowest, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of any orderable type to (node, component), component being the smallest node reachable.

    Large-star and small-star steps alternate until the edge set stands still. Each step takes a grouped minimum
    (combined before the shuffle) and a join with a side that has one row per node, which AQE can split when a node
    is hot; no group is gathered in a task. Nulls and self-links are left out: such nodes are their own component.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    e = staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    kind = e.schema["u"].dataType
    while True:
        # large star: every neighbour above u moves to the least of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _relink(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        # small star: u and the neighbours below it move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = _relink(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        old = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        new = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = small
        if old == new:
            break
    leaves = e.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
