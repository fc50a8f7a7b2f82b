"""Dates from many spellings, ages and delays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import column

# Year-month-day spellings that are accepted, tried in this order.
DATE_PATTERNS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d")


def lenient_date(c: str | Column, patterns: Sequence[str] = DATE_PATTERNS) -> Column:
    """First pattern that fits; NULL where none does."""
    c = F.trim(column(c).cast("string"))
    return F.coalesce(*[F.try_to_date(c, p) for p in patterns])


def with_century(c: str | Column, century: str = "19") -> Column:
    """``550101`` to the date 1955-01-01."""
    return lenient_date(F.concat(F.lit(century), column(c)))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(column(later), column(earlier))


def age_at(event: str | Column, birth: str | Column, stored: str | Column | None = None) -> Column:
    """Whole years of 365 days; the stored age where the birth date is missing."""
    years = F.floor(F.datediff(column(event), column(birth)) / 365).cast("double")
    if stored is None:
        return years
    return F.when(column(birth).isNull(), column(stored).try_cast("double")).otherwise(years)


def run_date(value: str | None = None) -> Column:
    """Date stamp of a run: the given date, so that a rerun writes to the same place, or today."""
    return F.to_date(F.lit(value)) if value else F.current_date()
