"""Tables behind plots: box numbers, histograms, stacked shares, burden distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import frequencies, quantiles
from .ordering import with_category_total
from .skew import attach
from .summaries import share_of_counts


def _with_fences(df: DataFrame, value: str, by: Sequence[str], weight: str | None) -> DataFrame:
    freq = materialise(frequencies(df, by, value, weight, "__n"))
    q = quantiles(freq, by, value, {"q1": .25, "median": .5, "q3": .75}, weight="__n", ready=True)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    q = q.withColumns({"__low": F.col("q1") - reach, "__high": F.col("q3") + reach})
    return attach(freq, q, by, "n")


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("__one", F.lit(1)), ["__one"])


def box_numbers(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 interquartile ranges) and outlier counts."""
    v = F.col(value)
    inside = v.between(F.col("__low"), F.col("__high"))
    df, key = _keyed(df, by)
    return _with_fences(df, value, key, weight).groupBy(*key).agg(
        F.max("n").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("__n"))), F.lit(0)).alias("n_outliers")).drop("__one")


def box_outliers(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Outlying values with their counts."""
    df, key = _keyed(df, by)
    return _with_fences(df, value, key, weight).filter(
        ~F.col(value).between(F.col("__low"), F.col("__high"))).select(*by, value, F.col("__n").alias("n"))


def histogram(df: DataFrame, value: str, width: float, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Counts per bin ``[i * width, (i + 1) * width)``."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    start = F.floor(F.col(value) / F.lit(float(width))) * F.lit(float(width))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, start.alias("bin_start")).agg(n.cast("bigint").alias("n"))


def histogram_equal(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins over the range; the last bin holds the maximum. Empty bins are left out."""
    v = F.col(value).cast("double")
    low, high = df.agg(F.min(v)).scalar(), df.agg(F.max(v)).scalar()
    width = (high - low) / bins
    # a range of one value has no width: everything is in bin 0
    place = F.least(F.coalesce(F.floor(F.try_divide(v - low, width)), F.lit(0)), F.lit(bins - 1))
    return df.filter(F.col(value).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def stacked_shares(df: DataFrame, category: str, part: str) -> DataFrame:
    """Counts and shares of parts per category with the category total for ordering."""
    counts = df.groupBy(category, part).agg(F.count(F.lit(1)).alias("n"))
    return with_category_total(share_of_counts(counts, [category]), category)


def burden_distribution(burden: DataFrame, name: str = "n_variant") -> DataFrame:
    return burden.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
