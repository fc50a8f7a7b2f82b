"""Row filters with the missing-value rules of the cohort scripts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_member
from .skew import own_exchange


def where_flag(df: DataFrame, name: str, value: int = 1) -> DataFrame:
    """Rows whose named 0/1 column has the value."""
    return df.filter(F.col(name) == value)


def members(df: DataFrame, name: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(name).isin(list(values)))


def non_members(df: DataFrame, name: str, values: Iterable) -> DataFrame:
    """Rows outside the list; a missing value is outside too."""
    return df.filter(~is_member(name, values))


def exclude_listed(df: DataFrame, excluded: DataFrame, key: str, listed: str | None = None) -> DataFrame:
    """Drop listed people; ids are compared with ``_`` read as ``-``.

    Spark broadcasts the list by its size at run time; a large list becomes a shuffled anti join.
    """
    ids = excluded.select(F.regexp_replace(F.col(listed or excluded.columns[0]), "_", "-").alias("__id")).distinct()
    return own_exchange(df, ids, [(key, "__id")], "left_anti")


def drop_missing(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in the named columns (in any column without names)."""
    return df.na.drop("any", subset=list(names) if names else None)


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows that are missing everywhere."""
    return df.na.drop("all")


def match_any(df: DataFrame, patterns: Mapping[str, str], key: str | None = None,
              ids: Iterable[str] = ()) -> DataFrame:
    """Rows where any named text column fits its pattern, or the id is listed."""
    test: Column = is_member(key, ids) if key else F.lit(False)
    for name, pattern in patterns.items():
        test = test | F.coalesce(F.col(name).rlike(pattern), F.lit(False))
    return df.filter(test)


def fill(df: DataFrame, values: Mapping | int | float | str) -> DataFrame:
    return df.na.fill(values)


def distinct_values(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct()
