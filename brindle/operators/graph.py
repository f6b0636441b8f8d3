"""Dependency graphs as edge tables (src, dst): metrics, components, cycles and topological levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.staging import staged


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_out, fan_in): edges out of a node, whatever they lead to, and into it."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    joined = nodes.join(out, "node", "left").join(into, "node", "left")
    return joined.select("node", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def roles(nodes: DataFrame, edges: DataFrame, hub: int = 3) -> DataFrame:
    """degrees() with is_root (nothing leads in), is_leaf (nothing leads out), is_hub (`hub` or more both ways)."""
    d = degrees(nodes, edges)
    return d.select("*", (F.col("fan_in") == 0).alias("is_root"), (F.col("fan_out") == 0).alias("is_leaf"), ((F.col("fan_in") >= hub) & (F.col("fan_out") >= hub)).alias("is_hub"))


def cross_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges whose ends have different owners (node, owner); ends without one drop out."""
    a, b = owner.toDF("src", "src_owner"), owner.toDF("dst", "dst_owner")
    return edges.join(a, "src").join(b, "dst").where("src_owner <> dst_owner").select("src", "dst", "src_owner", "dst_owner")


def coupling(edges: DataFrame, owner: DataFrame, least: int = 5) -> DataFrame:
    """Unordered pairs of owners and the edges between them, from `least` on."""
    pairs = cross_edges(edges, owner).select(F.least("src_owner", "dst_owner").alias("a"), F.greatest("src_owner", "dst_owner").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _trim(edges: DataFrame) -> DataFrame:
    """Drops edges at nodes that nothing leads to or from, until none is left to drop: these lie on no cycle."""
    n = edges.count()
    while n:
        edges = staged(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "trim")
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two or more nodes, named by their greatest node.

    Colouring: the greatest node that reaches a node, then, within a colour, what reaches its name. Edges that can't
    lie on a cycle are trimmed first and after each round. Every round is a chain of joins and grouped maxima over the edges
    that are left; nothing is gathered on one machine.
    """
    edges = _trim(staged(edges.where("src <> dst").select("src", "dst").distinct(), "edges"))
    found = None
    while not edges.isEmpty():
        colours = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("c", F.col("node"))
        colours = staged(colours, "colours")
        while True:
            pushed = edges.join(colours, edges.src == colours.node).select(F.col("dst").alias("node"), "c")
            new = staged(colours.unionByName(pushed).groupBy("node").agg(F.max("c").alias("c")), "colours")
            moved = new.join(colours, ["node", "c"], "left_anti").isEmpty()
            colours = new
            if moved:
                break
        a, b = colours.toDF("src", "ca"), colours.toDF("dst", "cb")
        inner = staged(edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("c")), "inner")
        reach = staged(colours.where("node = c"), "reach")
        while True:
            back = inner.join(reach.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c")
            grown = staged(reach.unionByName(back).distinct(), "reach")
            if grown.count() == reach.count():
                break
            reach = grown
        done = reach.select("node", F.col("c").alias("component"))
        found = done if found is None else found.unionByName(done)
        gone = reach.select("node")
        edges = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
        edges = _trim(staged(edges.select("src", "dst"), "edges"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return staged(found.join(sizes, "component", "left_semi").select("node", "component"), "components")


def levels(nodes: DataFrame, edges: DataFrame, on_cycle: str = "last") -> DataFrame:
    """(node, level): 0 for nodes that need nothing, else one more than the highest level that src -> dst hands on.

    Each round takes the nodes without an open src. On a cycle, "last" puts all the rest in one more level and
    "raise" raises ValueError.
    """
    rest, edges = staged(nodes.select("node").distinct(), "nodes"), edges.where("src <> dst").select("src", "dst").distinct()
    edges = staged(edges.join(rest.toDF("src"), "src", "left_semi").join(rest.toDF("dst"), "dst", "left_semi"), "edges")
    out, level = None, 0
    left = rest.count()
    while left:
        ready = rest.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        if ready.isEmpty():
            if on_cycle == "raise":
                raise ValueError("the graph has a cycle")
            ready = rest
        ready = staged(ready.withColumn("level", F.lit(level)), "level")
        out = ready if out is None else out.unionByName(ready)
        gone = ready.select("node")
        rest = staged(rest.join(gone, "node", "left_anti"), "nodes")
        edges = staged(edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"), "edges")
        left, level = rest.count(), level + 1
    return out if out is not None else nodes.select("node", F.lit(0).alias("level")).limit(0)


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """levels() in an order that keeps every src before its dst; raises on a cycle."""
    return levels(nodes, edges, "raise").orderBy("level", "node")
