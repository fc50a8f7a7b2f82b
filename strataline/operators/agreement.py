"""Agreement of two raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_two_sided
from .summaries import contingency


def percent_agreement(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    both = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                 (F.avg((F.col(first) == F.col(second)).cast("double")) * 100).alias("percent_agreement"))


def kappa(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Percent agreement and unweighted kappa with its test against chance, on complete pairs.

    Data is reduced to cells, then to one row per level with both margins.
    """
    cells = contingency(df, first, second, by)
    marks = F.array(F.struct(F.col("row_level").alias("level"), F.col("n").alias("r"), F.lit(0).cast("bigint").alias("c"),
                             F.when(F.col("row_level") == F.col("col_level"), F.col("n")).otherwise(0).alias("d")),
                    F.struct(F.col("col_level").alias("level"), F.lit(0).cast("bigint").alias("r"), F.col("n").alias("c"),
                             F.lit(0).cast("bigint").alias("d")))
    levels = cells.select(*by, F.explode(marks).alias("__m")).groupBy(*by, F.col("__m.level").alias("__level")).agg(
        F.sum("__m.r").cast("double").alias("__r"), F.sum("__m.c").cast("double").alias("__c"), F.sum("__m.d").cast("double").alias("__d"))
    out = levels.groupBy(*by).agg(
        F.sum("__r").alias("__n"), F.sum("__d").alias("__same"), F.sum(F.col("__r") * F.col("__c")).alias("__rc"),
        F.sum(F.col("__r") * F.col("__c") * (F.col("__r") + F.col("__c"))).alias("__rcs"))
    n = F.col("__n")
    out = out.withColumns({"__po": F.col("__same") / n, "__pe": F.col("__rc") / (n * n)})
    pe = F.col("__pe")
    variance = (pe + pe * pe - F.col("__rcs") / (n * n * n)) / n
    value = F.try_divide(F.col("__po") - pe, F.when(pe < 1, 1 - pe))
    z = F.try_divide(value * (1 - pe), F.when(variance > 0, F.sqrt(variance)))
    out = out.select(*by, n.cast("bigint").alias("n"), (F.col("__po") * 100).alias("percent_agreement"),
                     value.alias("kappa"), z.alias("z"))
    return out.withColumn("p_value", normal_two_sided("z"))
