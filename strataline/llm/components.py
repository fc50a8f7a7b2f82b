"""Connected components of a large edge list by repeated contraction.

Every round each node points at its smallest neighbour if that is smaller than itself; pointers are followed to their ends by doubling;
edges are rewritten to these ends, loops and repeats drop out, and the rest goes to the next round. Only local minima are left after a
round (half of the nodes at most). All tables are written to the shared folder round by round, which cuts the
lineage; nothing but the question "are edges left?" reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _moved(edges: DataFrame, pointer: DataFrame, end: str) -> DataFrame:
    p = pointer.select(F.col("node").alias("__node"), F.col("to").alias("__to"))
    return edges.join(p, F.col(end) == F.col("__node"), "left").withColumn(end, F.coalesce("__to", end)).drop("__node", "__to")


def components(edges: DataFrame) -> list[DataFrame]:
    """Pointer tables (node, to), to be followed one after another. ``edges``: u, v (bigint), any direction."""
    edges = materialise(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointer = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")).filter("to < node"))
        while True:
            further = _moved(pointer.withColumn("was", F.col("to")), pointer, "to")
            if further.filter("to <> was").isEmpty():
                break
            pointer = materialise(further.drop("was"))
        rounds.append(pointer)
        moved = _moved(_moved(edges, pointer, "u"), pointer, "v").filter("u <> v")
        edges = materialise(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return rounds


def follow(nodes: DataFrame, node: str, rounds: list[DataFrame], root: str) -> DataFrame:
    """``nodes`` with the smallest node of their component in ``root`` (the node itself where it has no edge)."""
    out = nodes.withColumn(root, F.col(node))
    for pointer in rounds:
        out = _moved(out, pointer, root)
    return out
