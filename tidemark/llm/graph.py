"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest ``weight`` reachable from each node; null weights come last.

    ``nodes`` is (node, weight) with distinct nodes, ``edges`` is (a, b) over nodes. Only nodes that have an edge take
    part in the rounds. Every node points to a node that is smaller (by weight, then by itself) or to itself. In a round,
    each node hears its neighbours' pointers, and takes the smallest for itself and for the node that it points to, so
    whole trees are hooked at once; then pointers are replaced by the pointers of their targets. Rounds grow with the
    logarithm of the longest path. They end when nothing moves, as they must: pointers only get smaller.
    All minima are pre-aggregated before their shuffle, so a node with very many neighbours is no hot spot.
    A round's tables are deleted when the next round has been written; the last one stays, as the result reads it.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    if both.isEmpty():
        return nodes.select("node", F.col("weight").alias("label"))
    touched = both.select(F.col("a").alias("node")).distinct()
    own = F.struct(F.col("weight").isNull().alias("last"), F.col("weight").alias("weight"), F.col("node").alias("node"))
    state = written(nodes.join(touched, "node", "left_semi").select("node", own.alias("to")))
    while True:
        heard = both.join(state.select(F.col("node").alias("a"), "to"), "a").groupBy(F.col("b").alias("node")).agg(F.min("to").alias("heard"))
        told = state.join(heard, "node")
        hooks = told.select("node", F.least("to", "heard").alias("to")).union(told.select("to.node", "heard"))
        stepped = written(hooks.groupBy("node").agg(F.min("to").alias("to")))
        ahead = stepped.select(F.col("node").alias("at"), F.col("to").alias("further"))
        jumped = written(stepped.join(ahead, F.col("to.node") == F.col("at")).select("node", F.least("to", "further").alias("to")))
        settled = jumped.join(state.select("node", F.col("to.node").alias("was")), "node").where("to.node <> was").isEmpty()
        discard(state, stepped)
        state = jumped
        if settled:
            break
    discard(both)
    found = state.select("node", F.col("to.weight").alias("label"), F.lit(True).alias("in"))
    joined = nodes.join(found, "node", "left")
    return joined.select("node", F.when(F.col("in"), F.col("label")).otherwise(F.col("weight")).alias("label"))
