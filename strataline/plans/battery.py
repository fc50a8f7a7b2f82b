"""Batteries of tests: variables become rows, so a whole battery is a few grouped jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coding import delay_bin
from ..functions.dates import days_between, lenient_date
from ..operators import means
from ..operators.agreement import kappa
from ..operators.joins import pair_methods
from ..operators.longitudinal import baseline, number_records
from ..operators.means import anova, bartlett_test, levene_test, t_test
from ..operators.normality import shapiro_wilk
from ..operators.reshape import stack, to_long
from ..operators.tables import chi_squared
from ..session import materialise


def variance_battery(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """Levene, Bartlett, ANOVA and Shapiro-Wilk for every variable: one tidy table."""
    # read by four tests: what lies behind it is computed once
    long = materialise(to_long(df.select(group, *[F.col(v).cast("double") for v in variables]), [group], variables))
    key = ["variable"]
    f = lambda d, name: d.select("variable", F.lit(name).alias("test"), "statistic",
                                 F.col("df_between").cast("double").alias("df1"), F.col("df_within").cast("double").alias("df2"), "p_value")
    none = F.lit(None).cast("double")
    bartlett = bartlett_test(long, "value", group, key).select(
        "variable", F.lit("bartlett").alias("test"), "statistic", F.col("df").cast("double").alias("df1"), none.alias("df2"), "p_value")
    normal = shapiro_wilk(long, "value", key).select(
        "variable", F.lit("shapiro").alias("test"), "statistic", none.alias("df1"), none.alias("df2"), "p_value")
    return stack(f(levene_test(long, "value", group, key), "levene"), bartlett,
                 f(anova(long, "value", group, key), "anova"), normal)


def _tests(t: DataFrame, x: DataFrame, by: Sequence[str]) -> DataFrame:
    t = t.select(*by, F.lit("t").alias("test"), (F.col("n_x") + F.col("n_y")).alias("n"), "mean_x", "mean_y", "sd_x",
                 "sd_y", "statistic", "df", "p_value")
    x = x.select(*by, F.lit("chi_squared").alias("test"), "n", "statistic", F.col("df").cast("double").alias("df"), "p_value")
    return stack(t, x)


def condition_battery(df: DataFrame, condition: str, continuous: Sequence[str], discrete: Sequence[str],
                      by: Sequence[str] = (), visits: DataFrame | None = None) -> DataFrame:
    """Welch tests of the continuous variables and chi-squared tests of the discrete ones between
    condition 1 and 0, plus the baseline values of each measurement in ``visits``."""
    keys = [*by, "variable"]
    # a discrete variable may be the condition or a stratum of the battery itself
    numbers = df.select(*by, F.col(condition).alias("__c"), *[F.col(c).cast("double").alias(c) for c in continuous])
    numbers = to_long(numbers, [*by, "__c"], continuous)
    if visits is not None:
        first = baseline(visits).select(*by, F.col(condition).alias("__c"), F.col("measurement").alias("variable"),
                                        F.col("measurement_value").cast("double").alias("value"))
        numbers = numbers.unionByName(first)
    levels = df.select(*by, F.col(condition).alias("__c"), *[F.col(c).cast("string").alias(f"__v_{c}") for c in discrete])
    levels = to_long(levels, [*by, "__c"], [f"__v_{c}" for c in discrete]).withColumn(
        "variable", F.regexp_replace("variable", "^__v_", ""))
    return _tests(t_test(numbers, "value", "__c", 1, 0, keys), chi_squared(levels, "__c", "value", keys), keys)


def strata_battery(df: DataFrame, conditions: Sequence[str], continuous: Sequence[str], discrete: Sequence[str],
                   outcome: str, stratum: str, overall: str = "All genders", visits: DataFrame | None = None) -> DataFrame:
    """Every condition within outcome, and within outcome and stratum: ``(condition, outcome, stratum, variable, …)``.

    Rows are aggregated once, over the cells of outcome, stratum, all conditions and all discrete variables: counts and moments
    (count, mean, sum of squares). Only cells are repeated for their stratum and the overall one and for every condition, and
    their moments merged. ``visits`` adds baseline values and yearly changes (overall only).
    """
    flags = [f"__f{i}" for i in range(len(conditions))]
    marked = [F.col(c).cast("int").alias(f) for f, c in zip(flags, conditions)]

    def spread(d: DataFrame, both: bool) -> DataFrame:
        marks = [F.lit(overall)] + ([F.col("__stratum")] if both else [])
        each = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f).alias("set")) for f, c in zip(flags, conditions)])
        return d.withColumn("__s", F.explode(F.array(*marks))).filter(F.col("__s").isNotNull()).withColumn(
            "__f", F.explode(each)).withColumns({"condition": F.col("__f.condition"), "__c": F.col("__f.set")})
    by = ["condition", outcome, "__s"]
    keys = [*by, "variable"]

    def moments(cells: DataFrame, names: Sequence[tuple[Column, str]]) -> DataFrame:
        """One row per cell and variable; ``names`` holds the variable and the column of its moments."""
        states = F.array(*[F.struct(v.alias("variable"), F.col(m).alias("of")) for v, m in names])
        return cells.select(*by, "__c", F.explode(states).alias("__m")).select(
            *by, "__c", "__m.variable", F.col("__m.of.mean").alias("value"), F.col("__m.of.n").alias("__n"), F.col("__m.of.within").alias("__within"))

    levels = [F.col(c).cast("string").alias(f"__v{i}") for i, c in enumerate(discrete)]
    people = df.groupBy(F.col(outcome), F.col(stratum).cast("string").alias("__stratum"), *marked, *levels).agg(
        F.count(F.lit(1)).alias("__rows"), *[means.moment_state(c).alias(f"__m{i}") for i, c in enumerate(continuous)])
    people = spread(materialise(people), True)  # read for the moments and for the counts
    parts = [moments(people, [(F.lit(c), f"__m{i}") for i, c in enumerate(continuous)])] if continuous else []
    if visits is not None:
        first = F.when((F.col("rank") == 1) | F.col("rank").isNull(), F.col("measurement_value"))
        seen = visits.select(outcome, *marked, "measurement", first.alias("__first"), "delta_per_year",
                             F.coalesce(F.col("rank") == 1, F.lit(True)).alias("__is_first"))
        seen = seen.groupBy(outcome, *flags, "measurement").agg(
            means.moment_state("__first").alias("__base"), means.moment_state("delta_per_year").alias("__change"), F.max("__is_first").alias("__any"))
        seen = spread(materialise(seen), False)
        parts.append(moments(seen.filter("__any"), [(F.col("measurement"), "__base")]))
        parts.append(moments(seen, [(F.concat(F.lit("change in "), F.col("measurement")), "__change")]))
    counts = people.select(*by, "__c", "__rows", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"__v{i}").alias("value")) for i, c in enumerate(discrete)]))
                           .alias("__l")).select(*by, "__c", "__rows", "__l.*") if discrete else None
    if counts is None:
        counts = people.select(*by, "__c", "__rows", F.lit("").alias("variable"), F.lit("").alias("value")).limit(0)
    if not parts:
        parts = [people.select(*by, "__c", F.lit("").alias("variable"), F.lit(0.0).alias("value"), F.col("__rows").alias("__n"), F.lit(0.0).alias("__within")).limit(0)]
    out = _tests(means.t_test(stack(*parts), "value", "__c", 1, 0, keys, weight="__n", within="__within"),
                 chi_squared(counts, "__c", "value", keys, weight="__rows"), keys)
    return out.withColumnRenamed("__s", stratum)


def method_rows(wide: DataFrame, methods: dict[str, int], width: int = 4) -> DataFrame:
    """Wide specimen rows (positions 1 id, 2 name, 4 and 6 dates, ``width`` columns per method) to
    one row per method. A row with any missing cell is dropped before."""
    whole = wide.na.drop("any")
    names = whole.columns
    parts = []
    for method, at in methods.items():
        parts.append(whole.select(
            F.col(names[0]).alias("id"), F.col(names[1]).alias("name"), lenient_date(names[3]).alias("condition_date"),
            lenient_date(names[5]).alias("onset_date"), F.lit(method).alias("method"),
            lenient_date(names[at - 1]).alias("method_date"), F.col(names[at]).alias("e"),
            F.col(names[at + 1]).alias("rdrp"), F.col(names[at + 2]).alias("result")))
    return stack(*parts)


def agreement_battery(rows: DataFrame, target: str, comparators: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Agreement and kappa of the target method with each comparator, overall and per delay bin, for
    delays since condition and since onset.

    Records are numbered per (id, method) in the given order and paired on (id, number); inside a
    bin only records of that bin are paired.
    """
    numbered = number_records(rows, ["id", "method"], order)
    numbered = numbered.withColumns({f"{b}_bin": delay_bin(days_between("method_date", f"{b}_date")) for b in ("condition", "onset")})
    bases = F.array(F.struct(F.lit("all").alias("base"), F.lit("all").alias("bin")),
                    *[F.struct(F.lit(b).alias("base"), F.col(f"{b}_bin").alias("bin")) for b in ("condition", "onset")])
    long = numbered.withColumn("__b", F.explode(bases)).select(
        "id", "num", "method", "result", F.col("__b.base").alias("base"), F.col("__b.bin").alias("bin")).filter(F.col("bin").isNotNull())
    parts = []
    for comparator in comparators:
        pairs = pair_methods(long, "method", target, comparator, ["base", "bin", "id", "num"], "result")
        parts.append(kappa(pairs, "target", "comparator", ["base", "bin"]).withColumn("comparator", F.lit(comparator)))
    return stack(*parts).select(F.lit(target).alias("target_method"), "comparator", "base", "bin", "n",
                                "percent_agreement", "kappa", "z", "p_value")
