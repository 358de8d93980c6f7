"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import superseded, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of the nodes of edges (a, b) that are no roots.

    Each round is joins and aggregations on the edges, whose number never grows; rounds grow with the logarithm of the longest chain.
    Loops and repeated edges are fine. Nodes of one type that can be ordered are meant.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, edges = edges, written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        superseded(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def extended_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node and root of the nodes whose root is new: kept roots (node, root; a component's smallest node may be missing, as its own root) and further edges (a, b).

    Edges are brought to the roots of their ends, and only these are joined anew. A component that no edge touches has no row here, and its rows aren't rewritten.
    """
    new = written(edges.where("a <> b").select("a", "b").distinct(), "new-edges")
    ends = new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = written(ends.join(roots.select("node", F.col("root").alias("held")), "node", "left").select("node", F.coalesce("held", "node").alias("root")), "ends")
    at = lambda side: own.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    between = new.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    moved = written(connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("to")), "moved")  # roots that are roots no more
    kept = roots.join(moved, "root").select("node", F.col("to").alias("root"))
    fresh = own.select(F.col("node")).join(roots.select("node"), "node", "left_anti").join(moved.withColumnRenamed("root", "node"), "node").select("node", F.col("to").alias("root"))
    return kept.unionByName(fresh).where("node <> root").distinct()
