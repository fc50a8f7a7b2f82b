"""Tail probabilities. The normal quantile is a plain column expression; the incomplete beta and
gamma functions, which Spark lacks, are Arrow batches over result tables (one row per test)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .missing import column


def _each(f, x):
    """A scalar function over an array (a plain function, so that it can travel with the tasks)."""
    x = np.asarray(x, dtype=float)
    return np.array([f(v) for v in x.ravel().tolist()], dtype=float).reshape(x.shape)


def _lgamma(x):
    return _each(math.lgamma, x)


def _erfc(x):
    return _each(math.erfc, x)


# Rational approximation of the normal quantile (Wichura 1988, algorithm AS 241),
# lowest power first.
QUANTILE_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
QUANTILE_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
QUANTILE_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)


def polynomial(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def normal_quantile(p: str | Column) -> Column:
    """Standard normal quantile of 0 < p < 1, JVM-side."""
    p = column(p)
    q = p - 0.5
    ratio = lambda pair, x: polynomial(x, pair[0]) / polynomial(x, pair[1])
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(QUANTILE_MIDDLE, r - 1.6)).otherwise(ratio(QUANTILE_TAIL, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(QUANTILE_CENTRE, 0.180625 - q * q)).otherwise(
        F.signum(q) * tail)


# --- small vectorised helpers used inside the Arrow batches ---------------------------------

#: Both parameters above this: the beta integral is taken by quadrature around its peak.
WIDE = 1000.0
#: One parameter above this and the other at most WIDE: the beta integral goes over to the gamma integral.
STEEP = 1e8
#: Gamma shape above this: uniform expansion around the mean.
LARGE_SHAPE = 1e4
MOST_STEPS = 40_000
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
# Series of the first two terms of the uniform expansion of the incomplete gamma function (Temme 1979), lowest power first.
TEMME = (
    (-3.3333333333333333e-1, 8.3333333333333333e-2, -1.4814814814814815e-2, 1.1574074074074074e-3, 3.527336860670194e-4,
     -1.7875514403292181e-4, 3.9192631785224378e-5),
    (-1.8518518518518519e-3, -3.4722222222222222e-3, 2.6455026455026455e-3, -9.9022633744855967e-4, 2.0576131687242798e-4),
)


def _log_ratio(a, b):
    """ln(Gamma(a + b) / Gamma(a)) without the cancellation of two large terms."""
    with np.errstate(all="ignore"):
        large = (a + b - 0.5) * np.log1p(b / a) + b * (np.log(a) - 1) + (1 / (a + b) - 1 / a) / 12
    plain = np.zeros_like(a)
    small = a < 1e4
    if small.any():
        plain[small] = _lgamma(a[small] + b[small]) - _lgamma(a[small])
    return np.where(small, plain, large)


def _gamma_uniform(a, x):
    """Upper incomplete gamma share for large shapes."""
    d = (x - a) / a
    # d - ln(1 + d), by its series where the difference would cancel
    series = d * d * (1 / 2 - d * (1 / 3 - d * (1 / 4 - d * (1 / 5 - d * (1 / 6 - d / 7)))))
    half = np.where(np.abs(d) < 1e-2, series, d - np.log1p(np.maximum(d, -1 + 1e-300)))
    eta = np.sign(d) * np.sqrt(2 * half)
    near = np.abs(eta) < 0.3
    safe, safe_d = np.where(near, 1.0, eta), np.where(near, 1.0, d)
    c0 = np.where(near, np.polynomial.polynomial.polyval(eta, TEMME[0]), 1 / safe_d - 1 / safe)
    c1 = np.where(near, np.polynomial.polynomial.polyval(eta, TEMME[1]), 1 / safe**3 - 1 / safe_d**3 - 1 / safe_d**2 - 1 / (12 * safe_d))
    rest = np.exp(-a * half) / np.sqrt(2 * np.pi * a) * (c0 + c1 / a)
    return np.clip(_erfc(eta * np.sqrt(a / 2)) / 2 + rest, 0.0, 1.0)


def _beta_wide(x, a, b):
    """Beta share for two large parameters: the density around its peak, integrated from x to where nothing is left."""
    n = a + b
    mu, sd = a / n, np.sqrt(a * b / (n * n * (n + 1)))
    upper = x > mu
    end = np.where(upper, np.minimum(1.0, np.maximum(mu + 12 * sd, x + 6 * sd)), np.maximum(0.0, np.minimum(mu - 12 * sd, x - 6 * sd)))
    offset = (x - mu)[:, None] + (end - x)[:, None] * (_NODES + 1)[None, :] / 2
    up, down = offset / mu[:, None], offset / (b / n)[:, None]
    power = (a - 1)[:, None] * np.log1p(np.maximum(up, -1 + 1e-16)) + (b - 1)[:, None] * np.log1p(-np.minimum(down, 1 - 1e-16))
    peak = np.sqrt(n) * n / np.sqrt(2 * np.pi * a * b) * np.exp((1 / n - 1 / a - 1 / b) / 12)
    area = np.abs(end - x) / 2 * peak * (np.exp(power) * _WEIGHTS[None, :]).sum(axis=1)
    return np.clip(np.where(upper, 1 - area, area), 0.0, 1.0)


def _beta_steep(x, a, b):
    """Beta share for b far above a: the gamma integral at a corrected argument."""
    argument = -np.log1p(-np.minimum(x, 1 - 1e-16)) * (b + (a - 1) / 2)
    return 1 - gamma_tail(a, argument)

def beta_share(x, a, b):
    """Regularised incomplete beta function: continued fraction, quadrature for two large parameters, gamma integral for one very
    large one. NaN where none of them converges."""
    x, a, b = (np.array(v, dtype=float) for v in np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, dtype=float)) for v in (x, a, b))))
    x = np.clip(x, 0.0, 1.0)
    out = np.full(x.shape, np.nan)
    least, most = np.minimum(a, b), np.maximum(a, b)
    wide = least > WIDE
    low, high = ~wide & (most > STEEP) & (b >= a), ~wide & (most > STEEP) & (a > b)
    rest = ~(wide | low | high)
    if wide.any():
        out[wide] = _beta_wide(x[wide], a[wide], b[wide])
    if low.any():
        out[low] = _beta_steep(x[low], a[low], b[low])
    if high.any():
        out[high] = 1 - _beta_steep(1 - x[high], b[high], a[high])
    if rest.any():
        out[rest] = _beta_fraction(x[rest], a[rest], b[rest])
    return out


def _f_tail(f, m, n):
    """Upper tail of the F distribution. For very many denominator degrees the share is near 1 and its rest is taken directly."""
    out = beta_share(n / (n + m * f), n / 2, m / 2)
    many = (n > 1e7) & (m / 2 <= WIDE)
    if many.any():
        y = m[many] * f[many] / n[many]
        out[many] = gamma_tail(m[many] / 2, np.log1p(y) * (n[many] / 2 + (m[many] / 2 - 1) / 2))
    return out


def _beta_fraction(x, a, b):
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(np.where(p > q, _log_ratio(p, q) - _lgamma(q), _log_ratio(q, p) - _lgamma(p))
                       + p * np.log(np.where(y > 0, y, 1)) + q * np.log1p(-y)) / p
        tiny = 1e-300
        nonzero = lambda v: np.where(np.abs(v) < tiny, tiny, v)
        c = np.ones_like(y)
        d = 1 / nonzero(1 - (p + q) * y / (p + 1))
        h = d.copy()
        for m in range(1, MOST_STEPS):
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            d = 1 / nonzero(1 + even * d)
            c = nonzero(1 + even / c)
            h = h * d * c
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 / nonzero(1 + odd * d)
            c = nonzero(1 + odd / c)
            h = h * d * c
            last = np.abs(d * c - 1)
            if np.nanmax(last, initial=0.0) < 1e-15:
                break
        h = np.where(last < 1e-9, h, np.nan)
        part = np.where(y > 0, front * h, 0.0)
    return np.where(flip, 1 - part, part)


def gamma_tail(a, x):
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above, uniform expansion for large shapes.
    NaN where none of them converges."""
    a, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(np.atleast_1d(np.asarray(a, dtype=float)), np.atleast_1d(np.asarray(x, dtype=float))))
    large = a > LARGE_SHAPE
    out = np.full(a.shape, np.nan)
    if large.any():
        out[large] = np.where(x[large] <= 0, 1.0, _gamma_uniform(a[large], np.maximum(x[large], 0.0)))
    if not large.all():
        out[~large] = _gamma_series(a[~large], x[~large])
    return out


def _gamma_series(a, x):
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(np.where(x > 0, x, 1)) - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for k in range(1, MOST_STEPS):
            term = term * x / (a + k)
            total = total + term
            if np.nanmax(np.where(x < a + 1, term / total, 0), initial=0.0) < 1e-16:
                break
        low = np.where(term / total < 1e-9, front * total, np.nan)
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for k in range(1, MOST_STEPS):
            step = -k * (k - a)
            b = b + 2
            d = 1 / np.where(np.abs(step * d + b) < 1e-300, 1e-300, step * d + b)
            c = np.where(np.abs(b + step / c) < 1e-300, 1e-300, b + step / c)
            h = h * d * c
            last = np.abs(d * c - 1)
            if np.nanmax(np.where(x >= a + 1, last, 0), initial=0.0) < 1e-15:
                break
        h = np.where(last < 1e-9, h, np.nan)
        return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - low, front * h))


def beta_point(p, a, b):
    """Quantile of the beta distribution by bisection."""
    p, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (p, a, b)))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        middle = (low + high) / 2
        below = beta_share(middle, a, b) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def _rows(f, *series):
    values = [s.to_numpy(dtype=float, na_value=np.nan) for s in series]
    known = ~np.isnan(np.vstack(values)).any(axis=0)
    out = np.full(len(series[0]), np.nan)
    if known.any():
        out[known] = f(*[v[known] for v in values])
    return pd.Series(out, dtype="object").where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(lambda t, v: _f_tail(t * t, np.ones_like(v), v), t, df)


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _rows(_f_tail, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(lambda x, v: gamma_tail(v / 2, x / 2), x, df)


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    half = lambda z: gamma_tail(np.full_like(z, 0.5), z * z / 2) / 2
    return _rows(lambda z: np.where(z >= 0, half(z), 1 - half(z)), z)


@F.pandas_udf(T.DoubleType())
def binomial_low(k: pd.Series, n: pd.Series) -> pd.Series:
    """Lower end of the exact 95 % interval of a share."""
    return _rows(lambda k, n: np.where(k <= 0, 0.0, beta_point(0.025, np.maximum(k, 1), n - k + 1)),
                 k, n)


@F.pandas_udf(T.DoubleType())
def binomial_high(k: pd.Series, n: pd.Series) -> pd.Series:
    """Upper end of the exact 95 % interval of a share."""
    return _rows(lambda k, n: np.where(k >= n, 1.0, beta_point(0.975, k + 1, np.maximum(n - k, 1))),
                 k, n)


@F.pandas_udf(T.DoubleType())
def binomial_at_least(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Chance of k or more successes."""
    return _rows(lambda k, n, p: np.where(k <= 0, 1.0, beta_share(p, np.maximum(k, 1), n - k + 1)),
                 k, n, p)


def normal_two_sided(z: str | Column) -> Column:
    return 2 * normal_upper(F.abs(column(z)))
