"""Shapiro-Wilk test and normal quantile-quantile points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_quantile, normal_upper, polynomial
from .ordered import ordered_scan, quantiles
from .skew import attach, attach_size

CALIBRATED = 5000  # fixed value: the p-value was calibrated for 3 to 5000 values

# Polynomial coefficients (lowest power first) of Royston 1995, algorithm AS R94.
WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
WEIGHT_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_BOUND = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """W and p per group, for every group of 3 values or more. Large groups are ordered in pieces; groups above 5000 values
    carry a note that the p-value lies beyond the calibrated range."""
    key = list(by) or ["__one"]
    data = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    if not by:
        data = data.withColumn("__one", F.lit(1))
    sizes = data.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    fits = F.col("n") >= 3
    ranked = ordered_scan(attach(data, sizes, key).filter(fits), key, ["__x"], row_number="__i")
    m = normal_quantile((F.col("__i") - 0.375) / (F.col("n") + 0.25))
    ranked = ranked.withColumn("__m", m)
    i, n, x, mm = F.col("__i"), F.col("n"), F.col("__x"), F.col("__m")
    at = lambda place, c: F.max(F.when(place, c))
    inner = (i > 2) & (i < n - 1)
    rows = ranked.groupBy(*key, "n").agg(
        F.sum(mm * mm).alias("mm"), F.sum(F.when(inner, mm * x)).alias("inner"),
        at(i == n, x).alias("x_n"), at(i == n - 1, x).alias("x_n1"), at(i == 1, x).alias("x_1"), at(i == 2, x).alias("x_2"),
        at(i == n, mm).alias("m_n"), at(i == n - 1, mm).alias("m_n1"), (F.var_pop(x) * F.count(x)).alias("ss"))
    u = 1 / F.sqrt(F.col("n"))
    a_last = polynomial(u, WEIGHT_LAST) + F.col("m_n") / F.sqrt("mm")
    a_second = polynomial(u, WEIGHT_SECOND) + F.col("m_n1") / F.sqrt("mm")
    rows = rows.withColumns({"a_n": F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(a_last), "a_n1": a_second})
    an, an1, mn, mn1 = (F.col(c) for c in ("a_n", "a_n1", "m_n", "m_n1"))
    one = (F.col("mm") - 2 * mn * mn) / (1 - 2 * an * an)
    two = (F.col("mm") - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)
    second = F.col("x_n1") - F.col("x_2")
    ends = an * (F.col("x_n") - F.col("x_1"))
    inside = F.coalesce(F.col("inner"), F.lit(0.0))
    fit = F.when(F.col("n") == 3, ends).when(
        F.col("n") <= 5, ends + (inside + F.when(F.col("n") > 3, mn1 * second).otherwise(0.0)) / F.sqrt(one)).otherwise(
        ends + an1 * second + inside / F.sqrt(two))
    share = fit * fit / F.when(F.col("ss") > 0, F.col("ss"))
    w = F.when(share > 1, 1.0).otherwise(share)
    rows = rows.withColumn("w", w)
    size, ln_n = F.col("n").cast("double"), F.ln(F.col("n").cast("double"))
    y = F.ln(1 - F.col("w"))
    bound = polynomial(size, SMALL_BOUND)
    z = F.when(F.col("n") <= 11, (-F.ln(bound - y) - polynomial(size, SMALL_MEAN)) / F.exp(polynomial(size, SMALL_LOG_SD))
               ).otherwise((y - polynomial(ln_n, LARGE_MEAN)) / F.exp(polynomial(ln_n, LARGE_LOG_SD)))
    exact = 6 / F.lit(3.141592653589793) * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75))))
    exact = F.when(exact < 0, 0.0).otherwise(exact)
    rows = rows.withColumn("p_value", F.when(F.col("n") == 3, exact).when(
        (F.col("n") <= 11) & (y >= bound), F.lit(0.0)).otherwise(normal_upper(z)))
    rows = rows.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col("w").alias("statistic"), "p_value")
    on = reduce(lambda a, b: a & b, [sizes[k].eqNullSafe(rows[f"__k_{k}"]) for k in key])
    note = F.when(F.col("n") < 3, "fewer than 3 values").when(F.col("statistic").isNull(), "all values equal").when(
        F.col("n") > CALIBRATED, f"p-value calibrated up to {CALIBRATED} values").otherwise("")
    return sizes.join(rows, on, "left").select(*by, "n", "statistic", "p_value", note.alias("note"))


def qq_points(df: DataFrame, value: str, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Sorted values against normal quantiles, with the line through both quartile pairs.

    Plotting position ``(i - 0.5) / n``, or ``(i - 3/8) / (n + 1/4)`` up to ten values.
    """
    key = list(by) or ["__one"]
    data = df.filter(F.col(value).isNotNull())
    if not by:
        data = data.withColumn("__one", F.lit(1))
    data = data.select(*key, *tie, F.col(value).cast("double").alias("sample"))
    sized = attach_size(data, key)
    ranked = ordered_scan(sized, key, ["sample", *tie], row_number="i")
    offset = F.when(F.col("n") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    position = (F.col("i") - offset) / (F.col("n") + 1 - 2 * offset)
    points = ranked.withColumn("theoretical", normal_quantile(position))
    q = quantiles(data, key, "sample", {"__q1": .25, "__q3": .75}).withColumnRenamed("n", "__size")
    out = attach(points, q, key, "__size", keep_size=False)
    spread = normal_quantile(F.lit(0.75))
    slope = (F.col("__q3") - F.col("__q1")) / (2 * spread)
    return out.withColumns({"line_slope": slope, "line_intercept": F.col("__q1") + slope * spread}).select(
        *by, *tie, "i", "theoretical", "sample", "line_slope", "line_intercept")
