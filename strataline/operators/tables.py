"""Chi-squared tests on contingency cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from .skew import attach
from .summaries import contingency

CHI = ["n", "n_rows", "n_cols", "statistic", "df", "p_value", "note"]


def _two_by_two(a: Column, b: Column, c: Column, d: Column, correct: bool) -> Column:
    """Statistic of one 2x2 table from its four counts; NULL when a margin is empty."""
    n = a + b + c + d
    r1, r2, c1, c2 = a + b, c + d, a + c, b + d
    gap = F.abs(a - r1 * c1 / n)
    gap = gap - F.least(F.lit(0.5), gap) if correct else gap
    return F.try_divide(gap * gap * n * n * n, F.nullif(r1 * r2 * c1 * c2, F.lit(0.0)))


def _margin(cells: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    sums = cells.groupBy(*keys).agg(F.sum("n").alias(name), F.count(F.lit(1)).alias("__rows"))
    return attach(cells, sums, keys, "__rows", keep_size=False)


def chi_squared_cells(cells: DataFrame, by: Sequence[str] = (), correct: bool = True) -> DataFrame:
    """Chi-squared test per key from long cells ``(by…, row_level, col_level, n)``.

    The sum runs over present cells only: ``sum(O^2 / E) - N`` needs no zero cells. 2x2 tables get
    the continuity correction, from the margins and one cell. One level only: NULL with a note.
    """
    key = list(by) or ["__one"]
    if not by:
        cells = cells.withColumn("__one", F.lit(1))
    cells = cells.filter(F.col("n") > 0)
    wide = _margin(_margin(cells, [*key, "row_level"], "__r"), [*key, "col_level"], "__c")
    n, r, c = (F.col(x).cast("double") for x in ("n", "__r", "__c"))
    # sums over cells; margins are repeated per cell, so levels are counted as n / margin
    out = wide.groupBy(*key).agg(
        F.sum("n").cast("bigint").alias("n"), F.sum(n * n / (r * c)).alias("__q"),
        F.round(F.sum(n / r)).cast("bigint").alias("n_rows"), F.round(F.sum(n / c)).cast("bigint").alias("n_cols"),
        F.max_by(F.struct(n.alias("o"), r.alias("r"), c.alias("c")), F.struct("row_level", "col_level")).alias("__cell"))
    total, o = F.col("n").cast("double"), F.col("__cell.o")
    b, d = F.col("__cell.r") - o, F.col("__cell.c") - o
    square = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    stat = F.when(square, _two_by_two(o, b, d, total - o - b - d, correct)).otherwise(
        F.greatest(total * (F.col("__q") - 1), F.lit(0.0)))
    usable = (F.col("n_rows") > 1) & (F.col("n_cols") > 1)
    out = out.withColumns({
        "statistic": F.when(usable, stat),
        "df": F.when(usable, (F.col("n_rows") - 1) * (F.col("n_cols") - 1)),
        "note": F.when(~usable, F.lit("single level")).otherwise(F.lit(""))})
    return out.withColumn("p_value", tails.chi2_upper("statistic", F.col("df").cast("double"))).select(*by, *CHI)


def chi_squared(df: DataFrame, row: str, col: str, by: Sequence[str] = (), weight: str | None = None,
                correct: bool = True) -> DataFrame:
    """Chi-squared test of independence per key; rows with a missing value are left out."""
    return chi_squared_cells(contingency(df, row, col, by, weight), by, correct)


def presence_chi_squared(calls: DataFrame, subjects: DataFrame, subject: str, site: Sequence[str], outcome: str,
                         correct: bool = True) -> DataFrame:
    """Carrier × outcome test per site (gene and coordinate) from the sparse calls.

    Non-carriers are group size minus carriers, so the subjects × sites grid is never built.
    """
    people = subjects.filter(F.col(outcome).isin(0, 1)).select(subject, outcome)
    carriers = calls.select(subject, *site).distinct().join(people, subject)
    out = carriers.groupBy(*site).agg(F.count_if(F.col(outcome) == 0).alias("carrier_normal"),
                                      F.count_if(F.col(outcome) == 1).alias("carrier_patient"))
    # a site whose carriers all lack a known outcome stays, with no carriers
    sites = calls.select(*site).distinct().withColumns({"carrier_normal": F.lit(0).cast("bigint"), "carrier_patient": F.lit(0).cast("bigint")})
    out = out.unionByName(sites).groupBy(*site).agg(F.max("carrier_normal").alias("carrier_normal"), F.max("carrier_patient").alias("carrier_patient"))
    size = lambda v: people.agg(F.count_if(F.col(outcome) == v)).scalar()
    out = out.withColumns({"absent_normal": size(0) - F.col("carrier_normal"),
                           "absent_patient": size(1) - F.col("carrier_patient")})
    a, b, c, d = (F.col(x).cast("double") for x in ("absent_normal", "carrier_normal", "absent_patient", "carrier_patient"))
    flat = (a + c == 0) | (b + d == 0) | (a + b == 0) | (c + d == 0)
    out = out.withColumns({
        "statistic": F.when(~flat, _two_by_two(a, b, c, d, correct)), "df": F.when(~flat, F.lit(1).cast("bigint")),
        "note": F.when(flat, F.lit("single level")).otherwise(F.lit(""))})
    return out.withColumn("p_value", tails.chi2_upper("statistic", F.col("df").cast("double")))


def association_screen(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chi-squared test for every pair of the named columns, all pairs in one pass.

    The pairs are pairs of column names (configuration), not of rows.
    """
    text = lambda c: F.col(c).cast("string")
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), text(a).alias("x"), text(b).alias("y"))
             for i, a in enumerate(names) for b in names[i + 1:]]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return chi_squared(long, "x", "y", ["first", "second"])
