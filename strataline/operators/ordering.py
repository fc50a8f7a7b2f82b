"""Sorting, top rows, category order, duplicate flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import sort_keys
from .skew import attach


def sort(df: DataFrame, *order: str) -> DataFrame:
    """``-name`` sorts descending; missing values come last either way."""
    return df.orderBy(*sort_keys(order))


def top(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """Best n rows: every task keeps its own n, then the n best of those."""
    return df.orderBy(*sort_keys(order)).limit(n)


def with_category_total(counts: DataFrame, category: str, n: str = "n", total: str = "category_total") -> DataFrame:
    """Display order of categories: the total over their parts."""
    totals = counts.groupBy(category).agg(F.sum(n).alias(total), F.count(F.lit(1)).alias("__rows"))
    return attach(counts, totals, [category], "__rows", keep_size=False)


def in_coordinate_order(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Range partitions in key order, each sorted: files written from this are globally ordered."""
    args = [partitions] if partitions else []
    return df.repartitionByRange(*args, *sort_keys(order)).sortWithinPartitions(*sort_keys(order))


def flag_duplicates(df: DataFrame, position: Sequence[str], quality: str, tie: str) -> DataFrame:
    """Mark all rows of a position but the one of best quality (lowest ``tie`` among equals; a missing quality ranks last).

    The best row per position is an aggregate that combines before the shuffle; rows of hot
    positions are spread before it is joined back.
    """
    best = df.groupBy(*position).agg(
        F.min_by(tie, F.struct(F.col(quality).isNull().alias("m"), (-F.col(quality)).alias("q"), F.col(tie).alias("t"))).alias("__best"),
        F.count(F.lit(1)).alias("__size"))
    out = attach(df, best, position, "__size", keep_size=False)
    return out.withColumn("duplicate", (F.col(tie) != F.col("__best")).cast("int")).drop("__best")


def duplicate_metrics(flagged: DataFrame, by: Sequence[str]) -> DataFrame:
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.sum("duplicate").cast("bigint").alias("duplicates"),
        F.avg("duplicate").alias("duplicate_share"))
