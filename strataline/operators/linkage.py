"""People behind linked rows: rows that share an identifier, directly or through others, are one person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .skew import attach_size


def _to_least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least of u and its neighbours in ``m``."""
    least = edges.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("m"))
    least = least.select("__u", F.least("__u", "m").alias("m"), F.xxhash64("__u").alias("__key"))
    # the computed key gives both sides an exchange of their own, so a node with very many neighbours can be split
    marked = edges.withColumn("__mine", F.xxhash64("u"))
    return marked.join(least, (F.col("__mine") == F.col("__key")) & (F.col("u") == F.col("__u"))).select("u", "v", "m")


def stars(edges: DataFrame) -> DataFrame:
    """Connected components: ``(node, root)`` for every node that is not the smallest of its component.

    ``edges``: ``(u, v)`` bigint, any direction. Rounds of two steps: every node hangs its larger neighbours on the least node
    it knows, then its smaller ones. Edges never grow in number by more than the nodes; each round is written to the shared folder.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # finished when every node has one parent and no parent has one itself
        unfinished = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        deep = edges.select(F.col("v").alias("w")).join(edges.select("u"), F.col("w") == F.col("u"), "left_semi")
        if unfinished.isEmpty() and deep.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = _to_least(materialise(large))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u <> v").distinct())


def with_person(linked: DataFrame, key: str, identifiers: Sequence[str], person: str = "person_id") -> DataFrame:
    """Rows with the smallest key of those that share an identifier with them, directly or through other rows.

    ``key`` holds whole numbers, one per row; a missing identifier connects nothing. An identifier that very many rows share gives
    one edge per row, not one per pair.
    """
    number = F.col(key).cast("bigint")
    values = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in identifiers])
    long = materialise(linked.select(number.alias("u"), F.explode(values).alias("i")).select("u", "i.*").filter(F.col("value").isNotNull()))
    first = long.groupBy("kind", "value").agg(F.min("u").alias("v")).select(
        F.xxhash64("kind", "value").alias("__key"), F.col("kind").alias("__kind"), F.col("value").alias("__value"), "v")
    marked = long.withColumn("__mine", F.xxhash64("kind", "value"))
    on = (F.col("__mine") == F.col("__key")) & (F.col("kind") == F.col("__kind")) & (F.col("value") == F.col("__value"))
    roots = stars(marked.join(first, on).select("u", "v"))
    return linked.join(roots, number == F.col("node"), "left").withColumn(person, F.coalesce("root", number)).drop("node", "root")


def people_with_several_keys(persons: DataFrame, person: str = "person_id", name: str = "n_keys") -> DataFrame:
    """Rows of people that the cascade of joins gave more than one key."""
    return attach_size(persons, [person], name).filter(F.col(name) > 1)
