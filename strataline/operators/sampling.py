"""Seeded samples. Draws come from a hash of id and seed, so reruns and lost tasks give the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(ids: Sequence[str], seed: int | str) -> Column:
    """Number in (0, 1) made from the id columns and the seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids])
    digits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(16 ** 12))


def _first(df: DataFrame, by: Sequence[str], score: Column, ids: Sequence[str], n: int) -> DataFrame:
    # Spark keeps only the n best rows per group in every task before the shuffle (window group limit)
    w = Window.partitionBy(*by).orderBy(F.col("__score").asc(), *[F.col(i).asc() for i in ids])
    scored = df.withColumn("__score", score)
    return scored.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__score", "__rank")


def stratified_sample(df: DataFrame, by: Sequence[str], n: int, ids: Sequence[str], seed: int = 20201012) -> DataFrame:
    """n rows per group (all rows of smaller groups)."""
    return _first(df, by, uniform(ids, seed), ids, n)


def weighted_sample(df: DataFrame, by: Sequence[str], weight: str, n: int, ids: Sequence[str], seed: int = 1) -> DataFrame:
    """n rows per group without replacement, chance by weight; rows of weight 0 are never drawn."""
    positive = df.filter(F.col(weight) > 0)
    return _first(positive, by, -F.log(uniform(ids, seed)) / F.col(weight), ids, n)


def split(df: DataFrame, ids: Sequence[str], validation_share: float = 0.25, seed: int = 28) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows; a row's side depends on its id only."""
    u = uniform(ids, seed)
    return df.filter(u >= validation_share), df.filter(u < validation_share)


def mark_split(df: DataFrame, ids: Sequence[str], validation_share: float = 0.25, seed: int = 28) -> DataFrame:
    return df.withColumn("validation", (uniform(ids, seed) < validation_share).cast("int"))
