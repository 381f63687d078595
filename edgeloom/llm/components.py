"""Connected components by contraction: in each round every node goes into the least node next to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def _ordered(node: str, turn: int) -> Column:
    """The order of a round: nodes themselves in rounds 0, 1, 3, 5, ..., which end stars at once; else by a hash that changes with the round."""
    plain = turn == 0 or turn % 2 == 1
    return F.struct((F.lit(0).cast("long") if plain else F.xxhash64(F.lit(turn), F.col(node))).alias("rank"), F.col(node).alias("near"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (a, b), component being the smallest node of its component.

    Each round merges every node into the least of itself and its neighbours (combined before the shuffle, so a hub
    costs one row a task) and goes on with the edges between merged nodes, until there are none. A round by hashes
    leaves at most 3/4 of the nodes that still have edges, as expected over the hashes, whatever the shape and labels
    of the graph, and any round at least one node less in each component, so rounds are logarithmic and the loop ends.
    Null ends and loops are dropped, repeated edges count once, an empty input gives an empty result.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = staged(edges.where("a is not null and b is not null and a <> b").select(low, high).distinct())
    steps: list[DataFrame] = []
    while left.limit(1).count():
        turn = len(steps)
        ends = left.select(F.col("a").alias("node"), _ordered("b", turn).alias("to")).unionByName(left.select(F.col("b").alias("node"), _ordered("a", turn).alias("to")))
        least = ends.groupBy("node").agg(F.min("to").alias("to"))
        step = staged(least.select("node", F.least("to", _ordered("node", turn))["near"].alias("into")))
        steps.append(step)
        a, b = (step.select(F.col("node").alias(f"_{x}"), F.col("into").alias(x)) for x in "ab")
        merged = left.withColumnsRenamed({"a": "_x", "b": "_y"}).join(a, F.col("_x") == F.col("_a")).join(b, F.col("_y") == F.col("_b"))
        rest = staged(merged.where("a <> b").select(low, high).distinct())
        drop_staged(left)
        left = rest
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    drop_staged(left)
    top = steps.pop()
    while steps:
        step = steps.pop()
        further = top.select(F.col("node").alias("_via"), F.col("into").alias("_top"))
        whole = staged(step.join(further, F.col("into") == F.col("_via"), "left").select("node", F.coalesce("_top", "into").alias("into")))
        drop_staged(step, top)
        top = whole
    names = top.groupBy(F.col("into").alias("_into")).agg(F.min("node").alias("component"))
    out = staged(top.join(names, F.col("into") == F.col("_into")).select("node", "component"))
    drop_staged(top)
    return out
