"""Diagnostic accuracy: confusion counts, scores, exact intervals, ROC and precision-recall curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..session import materialise
from .ordered import ordered_scan

Z95 = 1.959963984540054  # fixed value: 97.5 % point of the standard normal


def confusion_counts(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = (), positive=1) -> DataFrame:
    p, a = F.col(predicted), F.col(actual)
    known = df.filter(p.isNotNull() & a.isNotNull())
    return known.groupBy(*by).agg(
        F.count_if((p == positive) & (a == positive)).alias("tp"), F.count_if((p == positive) & (a != positive)).alias("fp"),
        F.count_if((p != positive) & (a == positive)).alias("fn"), F.count_if((p != positive) & (a != positive)).alias("tn"))


def scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, true-negative rate and negative predictive value.

    Precision, recall and F1 are 0 where their divisor is; the two negative shares are NULL there.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    or_zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns({
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "precision": or_zero(tp, tp + fp),
        "recall": or_zero(tp, tp + fn), "f1": or_zero(2 * tp, 2 * tp + fp + fn),
        "true_negative_rate": F.try_divide(tn, tn + fp), "negative_predictive_value": F.try_divide(tn, tn + fn)})


def diagnostics(counts: DataFrame) -> DataFrame:
    """Prevalences, sensitivity, specificity, predictive values (exact 95 % intervals), likelihood
    ratios and odds ratio (log-normal 95 % intervals)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    shares = {"apparent_prevalence": (tp + fp, n), "true_prevalence": (tp + fn, n), "sensitivity": (tp, tp + fn),
              "specificity": (tn, tn + fp), "ppv": (tp, tp + fp), "npv": (tn, tn + fn)}
    out: dict[str, Column] = {}
    for name, (k, of) in shares.items():
        whole = F.when(of > 0, of)
        out[name] = F.try_divide(k, of)
        out[f"{name}_low"] = tails.binomial_low(k, whole)
        out[f"{name}_high"] = tails.binomial_high(k, whole)
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    inverse = lambda c: F.try_divide(F.lit(1.0), c)
    ratios = {
        "lr_positive": (F.try_divide(sens, 1 - spec), inverse(tp) - inverse(tp + fn) + inverse(fp) - inverse(fp + tn)),
        "lr_negative": (F.try_divide(1 - sens, spec), inverse(fn) - inverse(tp + fn) + inverse(tn) - inverse(fp + tn)),
        "odds_ratio": (F.try_divide(tp * tn, fp * fn), inverse(tp) + inverse(fp) + inverse(fn) + inverse(tn))}
    for name, (value, variance) in ratios.items():
        half = Z95 * F.sqrt(variance)
        out[name] = value
        out[f"{name}_low"] = F.exp(F.ln(value) - half)
        out[f"{name}_high"] = F.exp(F.ln(value) + half)
    return counts.withColumns(out)


def confusion_summary(counts: DataFrame) -> DataFrame:
    """Accuracy with exact interval, no-information rate and its test, kappa, McNemar's test,
    balanced accuracy, detection rate and prevalence."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    rate = F.greatest(tp + fn, fp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    right = (tp + tn) / n
    off = F.abs(fp - fn)
    mcnemar = F.try_divide(F.pow(F.greatest(off - 1, F.lit(0.0)), F.lit(2)), F.when(fp + fn > 0, fp + fn))
    out = counts.withColumns({
        "accuracy": right, "accuracy_low": tails.binomial_low(tp + tn, n), "accuracy_high": tails.binomial_high(tp + tn, n),
        "no_information_rate": rate, "p_above_rate": tails.binomial_at_least(tp + tn, n, rate),
        "kappa": F.try_divide(right - chance, F.when(chance < 1, 1 - chance)), "mcnemar": mcnemar,
        "sensitivity": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp),
        "detection_rate": tp / n, "detection_prevalence": (tp + fp) / n, "prevalence": (tp + fn) / n})
    return out.withColumns({
        "balanced_accuracy": (F.col("sensitivity") + F.col("specificity")) / 2,
        "mcnemar_p": tails.chi2_upper("mcnemar", F.lit(1.0))})


def score_steps(df: DataFrame, score: str, label: str, by: Sequence[str] = (), positive=1) -> DataFrame:
    """Distinct scores, highest first, with positives and negatives at and above each.

    Rows are counted per distinct score before anything is ordered.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(*by, score).agg(
        F.count_if(F.col(label) == positive).alias("pos"), F.count_if(F.col(label) != positive).alias("neg"))
    counts = materialise(counts)  # read twice: measured, then scanned
    return ordered_scan(counts, by, [f"-{score}"], running={"tp": "pos", "fp": "neg"},
                        total={"positives": "pos", "negatives": "neg"})


def _first_point(steps: DataFrame, by: Sequence[str], score: str, kind, **values) -> DataFrame:
    keys = steps.select(*by).distinct() if by else steps.limit(1)
    return keys.select(*by, F.lit(None).cast(kind).alias(score), *[F.lit(v).alias(k) for k, v in values.items()])


def roc_points(df: DataFrame, score: str, label: str, by: Sequence[str] = (), positive=1) -> DataFrame:
    """ROC curve from (0, 0); equal scores make one point."""
    steps = score_steps(df, score, label, by, positive)
    points = steps.select(*by, score, F.try_divide("fp", "negatives").alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))
    return points.unionByName(_first_point(steps, by, score, points.schema[score].dataType, fpr=0.0, tpr=0.0))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), positive=1) -> DataFrame:
    """Area under the ROC curve in its rank form (ties count half)."""
    steps = score_steps(df, score, label, by, positive)
    below = F.col("negatives") - F.col("fp") + F.col("neg") / F.lit(2.0)
    return steps.groupBy(*by).agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        F.sum(F.col("pos") * below).alias("__u")).select(
        *by, "positives", "negatives",
        F.try_divide(F.col("__u"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"))


def pr_points(df: DataFrame, score: str, label: str, by: Sequence[str] = (), positive=1) -> DataFrame:
    """Precision-recall curve; it ends at recall 0 and precision 1."""
    steps = score_steps(df, score, label, by, positive)
    points = steps.select(*by, score, F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                          F.try_divide("tp", "positives").alias("recall"))
    return points.unionByName(_first_point(steps, by, score, points.schema[score].dataType, precision=1.0, recall=0.0))
