"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import persisted


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node reachable.

    Each round hooks every node to its least neighbour and carries the edges
    over to what their ends hooked to; edges within one node go. The number of
    rounds is logarithmic in practice, at most the longest path. Every round
    is written to the shared folder. Repeated edges and loops do no harm; no
    edges give an empty table.
    """
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    both = persisted(both.union(both.select("b", "a")).filter("a is not null and b is not null").distinct(), f"{label}-edges")
    labels = None
    while True:
        hook = persisted(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("to")), f"{label}-hooks")
        if hook.isEmpty():
            break
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            moved = labels.join(hook, labels["component"] == hook["a"], "left")
            labels = moved.select("node", F.coalesce("to", "component").alias("component"))
        at_b = hook.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = both.join(hook, "a").join(at_b, "b").filter("to <> to_b")
        both = persisted(moved.select(F.col("to").alias("a"), F.col("to_b").alias("b")).distinct(), f"{label}-edges")
        if both.isEmpty():
            break
    if labels is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return persisted(labels, f"{label}-labels")
