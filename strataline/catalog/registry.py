"""Register of runnable queries: operator ids, the Spark callable and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, deal_out, stored_bytes


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """Input tables of one scale folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder
        self._bytes: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self._folder}/{name}.parquet"
        out = self.spark.read.parquet(path)
        if name not in self._bytes:
            self._bytes[name] = stored_bytes(self.spark, path)
            deal_out(self.spark, sum(self._bytes.values()))
        return out


def query(operators: str, sql: str | None = None, digits: int = 6, **round_to: int):
    """Register ``f(tables) -> DataFrame``. Doubles are rounded to ``digits`` (``round_to`` per column)."""
    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            out = f(Tables(spark, folder))
            return out.select(*[
                (F.round(F.col(f"`{c}`"), round_to.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
                for c, t in out.dtypes])
        QUERIES[f.__name__] = Query(f.__name__, tuple(operators.split()), run, sql)
        return f
    return register
