"""Golden values of the test operators and tails against an independent implementation."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataline.functions import tails
from strataline.operators import accuracy, agreement, means, normality, tables
from strataline.operators.summaries import six_numbers

A = [5.1, 4.9, 6.2, 5.8, 6.0, 5.5]
B = [6.8, 7.1, 5.9, 8.0, 7.4]
C = [4.0, 9.0, 6.5, 5.0, 7.7, 3.1]


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([(g, v, "k") for g, vs in (("A", A), ("B", B), ("C", C)) for v in vs], "g string, v double, k string")


def near(row, **expected):
    for name, value in expected.items():
        # the stored p-values carry the error of the tail functions they came from (up to 5e-7)
        assert row[name] == pytest.approx(value, rel=1e-6, abs=1e-8), name


@pytest.mark.parametrize("weighted", [False, True])
def test_t(groups, weighted):
    df = groups.withColumn("w", F.lit(1)) if weighted else groups
    w = "w" if weighted else None
    near(rows(means.t_test(df, "v", "g", "A", "B", weight=w))[0], statistic=-3.59466905, df=6.71366898, p_value=0.00944700)
    near(rows(means.t_test(df, "v", "g", "A", "B", weight=w, var_equal=True))[0], statistic=-3.74157793, df=9, p_value=0.00461424)


def test_variances(groups):
    near(rows(means.anova(groups, "v", "g"))[0], ss_between=6.29603922, ss_within=29.18866667, statistic=1.50991051, df_between=2, df_within=14, p_value=0.25480687)
    near(rows(means.levene_test(groups, "v", "g"))[0], statistic=8.22175438, df_between=2, df_within=14, p_value=0.00434944)
    near(rows(means.bartlett_test(groups, "v", "g"))[0], statistic=9.91665727, df=2, p_value=0.00702466)


def test_choice_of_t_test(groups):
    got = rows(means.t_test_by_spread(groups, "v", "g", "A", "B", ["k"]))[0]
    assert got["var_equal"] == 1
    near(got, statistic=-3.74157793, df=9, p_value=0.00461424)
    got = rows(means.t_test_by_spread(groups, "v", "g", "A", "C", ["k"]))[0]
    assert got["var_equal"] == 0 and got["levene_p"] < 0.05


def test_f_tail_closed_form(spark):
    """With two numerator degrees of freedom the tail is ``(1 + 2 f / d) ** (-d / 2)``."""
    got = spark.createDataFrame([(1.50991051, 2.0, 14.0)], "f double, a double, b double").select(tails.f_upper("f", "a", "b")).first()[0]
    assert got == pytest.approx((1 + 2 * 1.50991051 / 14) ** -7, rel=1e-12)


def test_degenerate_t(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("B", 3.0)], "g string, v double")
    got = rows(means.t_test(df, "v", "g", "A", "B"))[0]
    assert got["statistic"] is None and got["p_value"] is None and got["mean_y"] == 2.5
    flat = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("B", 1.0), ("B", 1.0)], "g string, v double")
    assert rows(means.t_test(flat, "v", "g", "A", "B"))[0]["statistic"] is None


def test_shapiro(spark):
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("s", float(v)) for v in x] + [("two", 1.0), ("two", 2.0)] + [("flat", 1.0)] * 4, "g string, v double")
    got = {r["g"]: r for r in rows(normality.shapiro_wilk(df, "v", ["g"]))}
    near(got["s"], statistic=0.78881469, p_value=0.00670381)
    assert got["two"]["statistic"] is None and got["two"]["note"] == "fewer than 3 values"
    assert got["flat"]["note"] == "all values equal"


def test_shapiro_beyond_the_calibrated_size(spark):
    """Every size is answered; for large n, W is close to the squared correlation with the normal scores."""
    from statistics import NormalDist
    for n in (5001, 20_000):
        df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
        got = rows(normality.shapiro_wilk(df, "v", ["g"]))[0]
        m = [NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)]
        mean = (n - 1) / 2
        fit = sum(a * (i - mean) for i, a in enumerate(m)) ** 2 / (sum(a * a for a in m) * sum((i - mean) ** 2 for i in range(n)))
        assert got["n"] == n and abs(got["statistic"] - fit) < 1e-3 and got["p_value"] < 1e-10 and "5000" in got["note"]


def table(spark, *cells):
    return spark.createDataFrame([(r, c) for r, c, n in cells for _ in range(n)], "r int, c int")


def test_chi_squared(spark):
    df = table(spark, (1, 1, 10), (1, 0, 5), (0, 1, 4), (0, 0, 9))
    near(rows(tables.chi_squared(df, "r", "c"))[0], statistic=2.29743590, df=1, p_value=0.12958777)
    near(rows(tables.chi_squared(df, "r", "c", correct=False))[0], statistic=3.58974359, df=1, p_value=0.05813721)
    got = rows(tables.chi_squared(df.filter("c = 1"), "r", "c"))[0]
    assert got["statistic"] is None and got["note"] == "single level"


def test_chi_squared_zero_cell(spark):
    df = table(spark, (1, 1, 5), (0, 1, 4), (0, 0, 9))
    n, (a, b, c, d) = 18, (5, 0, 4, 9)
    expected = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    near(rows(tables.chi_squared(df, "r", "c"))[0], statistic=expected)


def test_kappa(spark):
    df = table(spark, (1, 1, 10), (1, 0, 5), (0, 1, 4), (0, 0, 9))
    near(rows(agreement.kappa(df, "r", "c"))[0], percent_agreement=67.857142857, kappa=0.35714286, z=1.89466187, p_value=0.05813721)


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(40, 15, 10, 35)], "tp long, fp long, fn long, tn long")


def test_diagnostics(counts):
    near(rows(accuracy.diagnostics(counts))[0], sensitivity=.8, sensitivity_low=.66281687, sensitivity_high=.89969776, specificity=.7, ppv=.72727273,
         npv=.77777778, lr_positive=2.66666667, lr_negative=.28571429, odds_ratio=9.33333333)


def test_confusion_summary(counts):
    near(rows(accuracy.confusion_summary(counts))[0], accuracy=.75, accuracy_low=.65344750, accuracy_high=.83122026, mcnemar=.64, mcnemar_p=.42371080,
         balanced_accuracy=.75, kappa=.5)


def test_auc_of_labels(spark):
    df = spark.createDataFrame([(1, 1)] * 40 + [(0, 1)] * 10 + [(1, 0)] * 15 + [(0, 0)] * 35, "s int, y int")
    near(rows(accuracy.auc(df, "s", "y"))[0], auc=.75)
    points = {(round(r["fpr"], 6), round(r["tpr"], 6)) for r in rows(accuracy.roc_points(df, "s", "y"))}
    assert points == {(0.0, 0.0), (0.3, 0.8), (1.0, 1.0)}


def test_effect_size(spark):
    got = spark.range(1).select(means.effect_size_of(8.08, 7.15, 2.8, 1.91).alias("d")).first()
    assert got.d == pytest.approx(-0.38803763, abs=1e-8)


def test_quartiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (8, 9, 10, 12, 20, 21)] + [(None,)], "x double")
    near(rows(six_numbers(df, "x"))[0], q1=9.25, median=11, q3=18, min=8, max=21, n_missing=1)


def test_tails_against_the_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    rng = np.random.default_rng(1)
    cases = [(float(t), float(v)) for t, v in zip(rng.normal(0, 3, 20), rng.uniform(1, 4000, 20))]
    got = spark.createDataFrame(cases, "t double, v double").select(tails.t_two_sided("t", "v")).collect()
    for (t, v), r in zip(cases, got):
        assert r[0] == pytest.approx(2 * d.TDistribution(v).cumulativeProbability(-abs(t)), rel=1e-8)
    cases = [(float(f), float(a), float(b)) for f, a, b in zip(rng.uniform(.1, 6, 20), rng.integers(1, 9, 20), rng.integers(2, 30000, 20))]
    got = spark.createDataFrame(cases, "f double, a double, b double").select(tails.f_upper("f", "a", "b")).collect()
    for (f, a, b), r in zip(cases, got):
        assert r[0] == pytest.approx(1 - d.FDistribution(a, b).cumulativeProbability(f), rel=1e-6, abs=1e-12)
    cases = [(float(x), float(k)) for x, k in zip(rng.uniform(.01, 60, 20), rng.integers(1, 40, 20))]
    got = spark.createDataFrame(cases, "x double, k double").select(tails.chi2_upper("x", "k")).collect()
    for (x, k), r in zip(cases, got):
        assert r[0] == pytest.approx(1 - d.ChiSquaredDistribution(k).cumulativeProbability(x), rel=1e-7, abs=1e-12)
    ps = [1e-6, 1e-5, .01, .2, .5, .77, .999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(tails.normal_quantile("p")).collect()
    normal = d.NormalDistribution()
    for p, r in zip(ps, got):
        assert r[0] == pytest.approx(normal.inverseCumulativeProbability(p), rel=1e-7, abs=1e-10)


def test_missing_statistics_give_missing_p(spark):
    got = spark.createDataFrame([(None, 3.0), (1.0, 3.0)], "x double, v double").select(tails.chi2_upper("x", "v")).collect()
    assert got[0][0] is None and got[1][0] is not None
