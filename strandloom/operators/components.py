"""Connected components of an edge table by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.stage import forget, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; component is the label of a node of it.

    Each round hooks every node to the smallest of itself and its neighbours and contracts the edges;
    only local minima stay, so the graph shrinks by a constant factor a round. A hot node costs
    one row a neighbour, and its minimum is combined before the shuffle. Loops are ignored.
    """
    edges = materialize(edges.where("a <> b").select("a", "b"), "edges")
    hooks = []
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hook = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("v")), "hooks")
        hooks.append(hook)
        left = edges.join(hook, F.col("a") == F.col("u")).select(F.col("v").alias("a"), "b")
        right = left.join(hook, F.col("b") == F.col("u")).select("a", F.col("v").alias("b")).where("a <> b")
        before, edges = edges, materialize(right.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        forget(before)
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = hooks[0].select(F.col("u").alias("node"), F.col("v").alias("component"))
    for hook in hooks[1:]:
        out = out.join(hook, F.col("component") == F.col("u"), "left").select("node", F.coalesce("v", "component").alias("component"))
    named = materialize(out, "components")
    forget(edges, *hooks)
    return named
