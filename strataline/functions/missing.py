"""Missing-value rules of the cohort scripts that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINELS = ("-", "ND", "#N/A")  # fixed values: texts that mean "missing"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else3(condition: Column, yes, no) -> Column:
    """Three-valued choice: a NULL condition gives NULL, not ``no``."""
    return F.when(condition, yes).when(~condition, no)


def is_member(c: str | Column, values: Iterable) -> Column:
    """Membership that is false, not NULL, for a missing value (so its negation keeps the row)."""
    return F.coalesce(column(c).isin(list(values)), F.lit(False))


def null_if(c: str | Column, sentinels: Iterable[str] = SENTINELS) -> Column:
    c = column(c)
    return F.when(c.isin(list(sentinels)), F.lit(None)).otherwise(c)


def number(c: str | Column) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return F.trim(column(c).cast("string")).try_cast("double")


def integer(c: str | Column) -> Column:
    """Text to whole number, truncated toward zero; other text becomes NULL."""
    return number(c).try_cast("bigint")


def first_known(*cs: str | Column) -> Column:
    return F.coalesce(*[column(c) for c in cs])


def all_known_mean(c: str | Column) -> Column:
    """Mean that is NULL as soon as one value of the group is."""
    c = column(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def all_known_sum(c: str | Column) -> Column:
    c = column(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def sort_keys(order: Iterable[str]) -> list[Column]:
    """``["a", "-b"]`` to ascending a, descending b, missing values last in both."""
    return [
        F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last()
        for o in order
    ]
