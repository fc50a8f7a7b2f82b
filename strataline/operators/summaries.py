"""Grouped summaries. Each is one aggregate that combines before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import all_known_mean
from .ordered import quantiles
from .skew import attach


def count_by(df: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))


def describe(df: DataFrame, by: Sequence[str], values: Sequence[str], na: str = "skip") -> DataFrame:
    """Rows, mean, standard deviation and standard error per group.

    ``na="propagate"`` makes mean and deviation NULL as soon as one value of the group is missing.
    """
    out: list[Column] = []
    for v in values:
        whole = F.count(F.lit(1)) == F.count(v)
        keep = (lambda c, w=whole: F.when(w, c)) if na == "propagate" else (lambda c: c)
        mean = all_known_mean(v) if na == "propagate" else F.avg(v)
        sd = keep(F.stddev_samp(v))
        out += [mean.alias(f"{v}_mean"), sd.alias(f"{v}_sd"),
                F.try_divide(sd, F.sqrt(F.count(F.lit(1)))).alias(f"{v}_se")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *out)


def count_where(df: DataFrame, by: Sequence[str], test: Column, n: str = "n") -> DataFrame:
    """Rows per group that pass the test; groups without any keep 0."""
    return df.groupBy(*by).agg(F.count_if(test).alias(n))


def shares(df: DataFrame, by: Sequence[str], within: Sequence[str] = (), n: str = "n",
           share: str = "proportion") -> DataFrame:
    """Counts with their share of the ``within`` total (of everything without it).

    The total is a second small aggregate over the counts, joined back to them.
    """
    counts = count_by(df, by, n)
    return share_of_counts(counts, within, n, share)


def share_of_counts(counts: DataFrame, within: Sequence[str] = (), n: str = "n", share: str = "proportion") -> DataFrame:
    if within:
        totals = counts.groupBy(*within).agg(F.sum(n).alias("__total"), F.count(F.lit(1)).alias("__rows"))
        out = attach(counts, totals, within, "__rows", keep_size=False)
        return out.withColumn(share, F.col(n) / F.col("__total")).drop("__total")
    return counts.withColumn(share, F.col(n) / counts.agg(F.sum(n)).scalar())


def contingency(df: DataFrame, row: str, col: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Long cells ``(by, row_level, col_level, n)`` over rows where both variables are known."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(
        *by, F.col(row).cast("string").alias("row_level"), F.col(col).cast("string").alias("col_level")).agg(
        n.cast("bigint").alias("n"))


def proportions(cells: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    out = share_of_counts(cells, by)
    return out if digits is None else out.withColumn("proportion", F.round("proportion", digits))


def column_sums(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row ``(feature, total)`` per column, from a single pass."""
    sums = df.agg(*[F.sum(f"`{c}`").alias(c) for c in names])
    return sums.unpivot([], list(names), "feature", "total")


def six_numbers(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean, maximum and the number of missing values; quartiles are exact."""
    basic = df.groupBy(*by).agg(
        F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"),
        F.count_if(F.col(value).isNull()).alias("n_missing"))
    q = quantiles(df, by, value, {"q1": .25, "median": .5, "q3": .75}).drop("n")
    if not by:
        # two one-row tables side by side
        return basic.select("min", *[q.select(c).scalar().alias(c) for c in ("q1", "median")], "mean",
                            q.select("q3").scalar().alias("q3"), "max", "n_missing")
    q = q.withColumnsRenamed({b: f"__{b}" for b in by})
    on = reduce(lambda a, b: a & b, [basic[b].eqNullSafe(q[f"__{b}"]) for b in by])
    return basic.join(q, on, "left").select(*by, "min", "q1", "median", "mean", "q3", "max", "n_missing")


def value_range(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def with_overall(df: DataFrame, stratum: str, overall: str, by: Sequence[str], *figures: Column) -> DataFrame:
    """Figures per stratum and over all strata in one pass.

    The overall rows are told by the grouping id: a missing stratum is a group of its own.
    """
    full = [F.col(c) for c in (*by, stratum)]
    sets = df.groupingSets([full, [F.col(c) for c in by]], *full).agg(
        F.grouping(stratum).alias("__all"), *figures)
    return sets.withColumn(stratum, F.when(F.col("__all") == 1, F.lit(overall)).otherwise(
        F.col(stratum).cast("string"))).drop("__all")


def distinct_counts(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count distinct key combinations per group: duplicates go before the table is made."""
    return df.select(*dict.fromkeys([*keys, *by])).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
