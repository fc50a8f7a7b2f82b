"""Exact matching of two groups, weights and balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_scan
from .skew import attach


def match_outcome(presence: str, case: str):
    """0: control without the marker, 1: case with it, NULL: neither."""
    a, b = F.col(presence), F.col(case)
    return F.when((a == 0) & (b == 0), 0).when((a == 1) & (b == 1), 1)


def exact_match(df: DataFrame, group: str, covariates: Sequence[str]) -> DataFrame:
    """Rows of covariate cells that hold both groups, with ``subclass`` and ``weights``.

    Cells are combined before the shuffle. Treated rows weigh 1; control rows
    ``(treated / control in the cell) * (all control / all treated)`` over matched rows.
    """
    cells = df.groupBy(*covariates).agg(
        F.count_if(F.col(group) == 1).alias("__t"), F.count_if(F.col(group) == 0).alias("__c"),
        F.count(F.lit(1)).alias("__size"))
    cells = cells.filter((F.col("__t") > 0) & (F.col("__c") > 0))
    balance = cells.agg((F.sum("__c") / F.sum("__t")).alias("b")).scalar()
    numbered = ordered_scan(cells, [], list(covariates), row_number="subclass")
    rows = attach(df.filter(F.col(group).isin(0, 1)), numbered, covariates, "__size", how="inner", keep_size=False)
    weight = F.when(F.col(group) == 1, F.lit(1.0)).otherwise(F.col("__t") / F.col("__c") * balance)
    return rows.withColumn("weights", weight).drop("__t", "__c")


def selection_weights(matched: DataFrame, subclass: Sequence[str], group: str) -> DataFrame:
    """Per subclass and group: rows and ``1 - share of the group in the subclass``."""
    from .summaries import shares
    out = shares(matched, [*subclass, group], subclass, share="__share")
    return out.withColumn("weights", 1 - F.col("__share")).drop("__share")


def balance(before: DataFrame, matched: DataFrame, group: str, covariate: str, weight: str = "weights") -> DataFrame:
    """Group sizes, means and standardised mean difference before and after matching.

    The difference is divided by the standard deviation of the treated group before matching.
    """
    def one(df: DataFrame, stage: str, w) -> DataFrame:
        g, x = F.col(group), F.col(covariate).cast("double")
        mean = lambda v: F.sum(F.when(g == v, x * w)) / F.sum(F.when(g == v, w))
        return df.agg(F.count_if(g == 1).alias("n_treated"), F.count_if(g == 0).alias("n_control"),
                      mean(1).alias("mean_treated"), mean(0).alias("mean_control")).withColumn("stage", F.lit(stage))
    sd = before.filter(F.col(group) == 1).agg(F.stddev_samp(F.col(covariate).cast("double"))).scalar()
    both = one(before, "all", F.lit(1.0)).unionByName(one(matched, "matched", F.col(weight)))
    return both.select("stage", "n_treated", "n_control", "mean_treated", "mean_control",
                       F.try_divide(F.col("mean_treated") - F.col("mean_control"), sd).alias("std_mean_diff"))
