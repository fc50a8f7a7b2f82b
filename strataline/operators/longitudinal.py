"""Repeated measurements: visit ranks, gaps, changes and trends per subject."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between, lenient_date
from ..functions.missing import null_if, number
from .joins import with_at_least
from .ordered import ordered_scan
from .reshape import stack, unpack


def visit_table(visits: DataFrame, subject: str = "id", date: str = "measurement_date", value: str = "measurement_value",
                measurement: str = "measurement", registration: str = "registration_date",
                tie: Sequence[str] = ()) -> DataFrame:
    """Rank, days since registration, days since the last visit, change and change per year.

    Ranks are dense over (days since registration, date) within subject and measurement; a missing
    date has no rank. Rows with equal keys need ``tie`` columns to have an order.
    """
    base = visits.withColumn("diff_btw_re_and_me", days_between(date, registration))
    keys = ["diff_btw_re_and_me", date]
    out = ordered_scan(base, [subject, measurement], [*keys, *tie], dense_rank="rank", dense_on=keys,
                       lag={"__date": date, "__value": value})
    gap = days_between(date, "__date")
    delta = F.col(value) - F.col("__value")
    # same-day visits have no rate: the ratio is undefined and stays NULL
    return out.withColumns({
        "rank": F.when(F.col("diff_btw_re_and_me").isNotNull() & F.col(date).isNotNull(), F.col("rank")),
        "diff_btw_me": gap, "delta": delta,
        "delta_per_year": F.try_divide(delta, gap / F.lit(365)),
    }).drop("__date", "__value")


def unpack_visits(wide: DataFrame, measures: Mapping[str, str], subject: str = "id", date: str = "measurement_date",
                  keep: Sequence[str] = (), sentinels: Sequence[str] = ("ND",)) -> DataFrame:
    """Packed value and date cells to rows ``(subject, keep…, date, measurement, value)``.

    ``measures`` maps the packed column to the measurement name. Sentinel texts become NULL.
    """
    parts = []
    for packed, name in measures.items():
        rows = unpack(wide.select(subject, *keep, packed, date), [packed, date])
        parts.append(rows.select(subject, *keep, lenient_date(date).alias(date), F.lit(name).alias("measurement"),
                                 number(null_if(packed, sentinels)).alias("measurement_value")))
    return stack(*parts)


def longitudinal_table(wide: DataFrame, measures: Mapping[str, str], subject: str = "id",
                       date: str = "measurement_date", registration: str = "registration_date",
                       keep: Sequence[str] = (), drop_missing: Sequence[str] = ()) -> DataFrame:
    """From the packed master table to ranked visits with changes.

    Measurements named in ``drop_missing`` lose rows without a value before ranking.
    """
    rows = unpack_visits(wide, measures, subject, date, [registration, *keep])
    if drop_missing:
        rows = rows.filter(~F.col("measurement").isin(list(drop_missing)) | F.col("measurement_value").isNotNull())
    return visit_table(rows, subject, date, registration=registration, tie=["measurement_value"])


def baseline(visits: DataFrame, rank: str = "rank") -> DataFrame:
    """First visit only; visits without a rank count as baseline."""
    return visits.filter((F.col(rank) == 1) | F.col(rank).isNull())


def number_records(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "num") -> DataFrame:
    return ordered_scan(df, by, order, row_number=name)


def trajectories(visits: DataFrame, condition: str, subject: str = "id", measurement: str = "measurement",
                 gap: str = "diff_btw_me", value: str = "measurement_value", rows: int = 2) -> DataFrame:
    """Points of subjects with enough visits, coloured by a known condition; a first visit is at 0."""
    kept = with_at_least(visits, [subject, measurement], rows).filter(F.col(condition).isNotNull())
    return kept.select(subject, measurement, (F.col(condition) != 0).alias(condition),
                       F.coalesce(F.col(gap), F.lit(0)).alias(gap), value)


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Least-squares line per group with the standard error of the slope; one aggregate."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.filter(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"), F.regr_sxx(b, a).alias("__sxx"), F.regr_syy(b, a).alias("__syy"),
        F.regr_sxy(b, a).alias("__sxy"))
    rest = F.greatest(F.col("__syy") - F.col("slope") * F.col("__sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(F.try_divide(rest, F.when(F.col("n") > 2, F.col("n") - 2)), F.col("__sxx")))
    return fit.withColumn("slope_se", se).drop("__sxx", "__syy", "__sxy")
