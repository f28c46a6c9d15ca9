"""Connected components by repeated contraction, in Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node of its component.

    Each round maps every node to the smallest of itself and its neighbours, moves edges along and drops those that became
    loops. A node that has a smaller neighbour goes, so at least half of the nodes with edges go in a round. Nothing is
    collected: groups are reduced by min with partial aggregation, and no node's neighbours meet in one task.
    No edges: an empty table. Loops, repeated and reversed edges are fine; edges with a null end are left out.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    root = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    live = edges.where("a <> b")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        step = durable(both.groupBy(F.col("a").alias("at")).agg(F.least("at", F.min("b")).alias("to")), "step")
        root = root.join(step, root.root == step["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
        one, two = step.select(F.col("at").alias("a"), F.col("to").alias("na")), step.select(F.col("at").alias("b"), F.col("to").alias("nb"))
        live = live.join(one, "a").join(two, "b").where("na <> nb").select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).distinct()
        root, live = durable(root, "roots"), durable(live, "live")
    return root
