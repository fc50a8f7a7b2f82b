"""Tests on means and variances: one row per ``by`` key, any number of keys in one job.

Every test takes an optional ``weight`` column with counts, so it can run on frequency tables.
Rows without value or group are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..session import materialise
from .ordered import frequencies, quantiles
from .skew import attach

COMPARE = ["n_x", "n_y", "mean_x", "mean_y", "sd_x", "sd_y"]


def _moments(value: str, test: Column, weight: str | None, within: str | None = None) -> tuple[Column, Column, Column]:
    """Count, mean and sample variance of the rows that pass the test. A weighted row stands for ``weight`` values around
    ``value``; ``within`` is their sum of squares (0 if they are all alike)."""
    v = F.when(test, F.col(value).cast("double"))
    if weight is None:
        return F.count(v), F.avg(v), F.var_samp(v)
    w = F.when(test & F.col(value).isNotNull(), F.col(weight))
    d = v - F.col("__centre")
    n, s, q = F.coalesce(F.sum(w), F.lit(0)), F.sum(w * d), F.sum(w * d * d + (F.col(within) if within else F.lit(0.0)))
    shift = F.try_divide(s, n)
    centre = F.max(F.when(test, F.col("__centre")))
    return n, centre + shift, F.try_divide(F.greatest(q - s * shift, F.lit(0.0)), F.when(n > 1, n - 1))


def _centred(df: DataFrame, value: str, keys: Sequence[str], weight: str | None, moments: bool = False) -> DataFrame:
    """Weighted rows with the mean of their group in ``__centre``: sums of squares around it do not cancel when the mean is
    large against the spread. One more small aggregate; plain rows do not need it. Rows that are ``moments`` of cells are
    as few as the cells, so a window does for them."""
    if weight is None:
        return df
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    if moments:
        w = Window.partitionBy(*keys)
        return df.withColumn("__centre", F.try_divide(F.sum(known * F.col(value)).over(w), F.sum(known).over(w)))
    means = df.groupBy(*keys).agg(F.try_divide(F.sum(known * F.col(value).cast("double")), F.sum(known)).alias("__centre"),
                                  F.count(F.lit(1)).alias("__rows"))
    return attach(df, means, keys, "__rows", keep_size=False)


def two_group_moments(df: DataFrame, value: str, group: str, x, y, by: Sequence[str] = (),
                      weight: str | None = None, within: str | None = None) -> DataFrame:
    nx, mx, vx = _moments(value, F.col(group) == x, weight, within)
    ny, my, vy = _moments(value, F.col(group) == y, weight, within)
    return _centred(df, value, [*by, group], weight, within is not None).groupBy(*by).agg(
        nx.cast("bigint").alias("n_x"), ny.cast("bigint").alias("n_y"), mx.alias("mean_x"), my.alias("mean_y"),
        vx.alias("__vx"), vy.alias("__vy"))


def _t_columns(m: DataFrame, pooled: Column) -> DataFrame:
    """Adds t, df and p; NULL where a group has fewer than two values or nothing varies."""
    nx, ny, vx, vy = (F.col(c) for c in ("n_x", "n_y", "__vx", "__vy"))
    usable = (nx > 1) & (ny > 1) & (vx + vy > 0)
    ex, ey = vx / nx, vy / ny
    together = ((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)
    error = F.sqrt(F.when(pooled, together * (1 / nx + 1 / ny)).otherwise(ex + ey))
    free = F.when(pooled, (nx + ny - 2).cast("double")).otherwise(
        F.pow(ex + ey, F.lit(2)) / (ex * ex / (nx - 1) + ey * ey / (ny - 1)))
    out = m.withColumns({
        "sd_x": F.sqrt("__vx"), "sd_y": F.sqrt("__vy"),
        "statistic": F.when(usable, (F.col("mean_x") - F.col("mean_y")) / error),
        "df": F.when(usable, free)})
    return out.withColumn("p_value", tails.t_two_sided("statistic", "df")).drop("__vx", "__vy")


def t_test(df: DataFrame, value: str, group: str, x, y, by: Sequence[str] = (), weight: str | None = None,
           var_equal: bool = False, within: str | None = None) -> DataFrame:
    """Two-sample t-test of group ``x`` against ``y`` (Welch unless ``var_equal``). With ``weight`` and ``within`` the rows are
    moments: count, mean (``value``) and sum of squares around it, which merge without cancelling."""
    m = two_group_moments(df, value, group, x, y, by, weight, within)
    return _t_columns(m, F.lit(var_equal)).select(*by, *COMPARE, "statistic", "df", "p_value")


def moment_state(value: str) -> Column:
    """Aggregate: count, mean and sum of squares around it of the known values, to be merged by ``t_test``."""
    v = F.col(value).cast("double")
    return F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("within"))


def _anova_from_groups(groups: DataFrame, by: Sequence[str], within: Column) -> DataFrame:
    """ANOVA row per key from group rows ``(by…, __n, __mean, …)``; ``within`` is a group's sum of squares."""
    grand = (F.sum(F.col("__n") * F.col("__mean")) / F.sum("__n")).alias("__grand")
    if by:
        means = groups.groupBy(*by).agg(grand, F.count(F.lit(1)).alias("__levels"))
        centred = attach(groups, means, by, "__levels")
    else:
        centred = groups.withColumn("__grand", groups.agg(grand).scalar())
    deviation = F.col("__mean") - F.col("__grand")
    out = centred.groupBy(*by).agg(
        F.sum("__n").cast("bigint").alias("__n"), F.count(F.lit(1)).alias("__k"),
        F.sum(F.col("__n") * deviation * deviation).alias("ss_between"), F.sum(within).alias("ss_within"))
    out = out.withColumns({"df_between": F.col("__k") - 1, "df_within": F.col("__n") - F.col("__k")})
    out = out.withColumns({
        "ms_between": F.try_divide("ss_between", "df_between"), "ms_within": F.try_divide("ss_within", "df_within")})
    out = out.withColumn("statistic", F.try_divide("ms_between", F.when(F.col("ms_within") > 0, F.col("ms_within"))))
    return out.withColumn("p_value", tails.f_upper("statistic", F.col("df_between").cast("double"),
                                                   F.col("df_within").cast("double"))).drop("__n", "__k")


ANOVA = ["df_between", "df_within", "ss_between", "ss_within", "ms_between", "ms_within", "statistic", "p_value"]


def group_moments(df: DataFrame, value: str, group: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    n, mean, var = _moments(value, F.lit(True), weight)
    known = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    return _centred(known, value, [*by, group], weight).groupBy(*by, group).agg(n.cast("bigint").alias("__n"), mean.alias("__mean"), var.alias("__var"))


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One-way analysis of variance."""
    groups = group_moments(df, value, group, by, weight)
    within = F.when(F.col("__n") > 1, (F.col("__n") - 1) * F.col("__var")).otherwise(0.0)
    return _anova_from_groups(groups, by, within).select(*by, *ANOVA)


def levene_test(df: DataFrame, value: str, group: str, by: Sequence[str] = (), weight: str | None = None,
                center: str = "median") -> DataFrame:
    """Levene's test: ANOVA on absolute deviations from the group median (or mean).

    Medians are exact and come from the frequency table, which also carries the deviations. That
    table is written to the checkpoint folder once and read by each step.
    """
    known = df.filter(F.col(group).isNotNull())
    return _levene(materialise(frequencies(known, [*by, group], value, weight, "__n")), value, group, by, center)


def _levene(freq: DataFrame, value: str, group: str, by: Sequence[str], center: str = "median") -> DataFrame:
    keys = [*by, group]
    if center == "median":
        centres = quantiles(freq, keys, value, {"__c": 0.5}, weight="__n", ready=True)
    else:
        centres = freq.groupBy(*keys).agg((F.sum(F.col("__n") * F.col(value)) / F.sum("__n")).alias("__c"),
                                          F.sum("__n").alias("n"))
    centres = centres.withColumnRenamed("n", "__size")
    spread = attach(freq, centres, keys, "__size", keep_size=False).withColumn(
        "__z", F.abs(F.col(value).cast("double") - F.col("__c")))
    return anova(spread, "__z", group, by, weight="__n").select(
        *by, "df_between", "df_within", "statistic", "p_value")


def bartlett_test(df: DataFrame, value: str, group: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Bartlett's test of equal variances; NULL where a group has no spread."""
    groups = group_moments(df, value, group, by, weight)
    m = F.col("__n") - 1
    out = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__k"), F.sum(m * F.col("__var")).alias("__ss"),
        F.sum(m * F.ln("__var")).alias("__logs"), F.sum(F.try_divide(F.lit(1.0), m)).alias("__inverse"),
        F.min("__var").alias("__least"), F.min("__n").alias("__smallest"), F.sum("__n").alias("__n"))
    free, k = (F.col("__n") - F.col("__k")).cast("double"), F.col("__k")
    stat = (free * F.ln(F.try_divide(F.col("__ss"), free)) - F.col("__logs")) / (
        1 + (F.col("__inverse") - F.try_divide(F.lit(1.0), free)) / (3 * F.when(k > 1, k - 1)))
    usable = (F.col("__smallest") > 1) & (F.col("__least") > 0) & (k > 1)
    out = out.withColumns({"statistic": F.when(usable, stat), "df": (k - 1).cast("bigint")})
    return out.withColumn("p_value", tails.chi2_upper("statistic", F.col("df").cast("double"))).select(
        *by, "statistic", "df", "p_value")


def t_test_by_spread(df: DataFrame, value: str, group: str, x, y, by: Sequence[str] = (),
                     weight: str | None = None, level: float = 0.05, ready: bool = False) -> DataFrame:
    """Pooled t-test where Levene's test does not reject equal variances, else Welch's.

    ``by`` must not be empty; the data is first reduced to a frequency table that both tests share.
    ``ready=True`` states that ``df`` already is one, with its counts in ``weight``.
    """
    two = df.filter(F.col(group).isin(x, y))
    if ready:
        freq = two.select(*by, group, value, F.col(weight).alias("__n"))
    else:
        freq = materialise(frequencies(two, [*by, group], value, weight, "__n"))
    levene = _levene(freq, value, group, by).select(
        *[F.col(b).alias(f"__l_{b}") for b in by], F.col("statistic").alias("levene_f"), F.col("p_value").alias("levene_p"))
    m = two_group_moments(freq, value, group, x, y, by, "__n")
    on = F.lit(True)
    for b in by:
        on = on & m[b].eqNullSafe(levene[f"__l_{b}"])
    joined = m.join(levene, on, "left").drop(*[f"__l_{b}" for b in by])
    joined = joined.withColumn("var_equal", F.col("levene_p") >= level)
    out = _t_columns(joined, F.coalesce(F.col("var_equal"), F.lit(False)))
    return out.select(*by, *COMPARE, "levene_f", "levene_p", F.col("var_equal").cast("int").alias("var_equal"),
                      "statistic", "df", "p_value")


def effect_size(df: DataFrame, value: str, group: str, x, y, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Cohen's d: difference of means over the root mean of both variances."""
    m = two_group_moments(df, value, group, x, y, by, weight)
    return m.withColumn("d", F.try_divide(F.col("mean_y") - F.col("mean_x"), F.sqrt(
        (F.col("__vx") + F.col("__vy")) / 2))).drop("__vx", "__vy")


def effect_size_of(m1, m2, s1, s2) -> Column:
    """Cohen's d from stored means and standard deviations."""
    c = [F.lit(v) if isinstance(v, (int, float)) else F.col(v) for v in (m1, m2, s1, s2)]
    return (c[1] - c[0]) / F.sqrt((c[2] * c[2] + c[3] * c[3]) / 2)
