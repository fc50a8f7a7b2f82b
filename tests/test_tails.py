"""Tail functions at sizes where a series alone would not end."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from strataline.functions import tails as T


def one(x):
    return float(np.atleast_1d(x)[0])


@pytest.mark.parametrize("a", [1e3, 1e4, 1e6, 1e7, 1e8, 1e12])
def test_gamma_at_its_mean(a):
    assert one(T.gamma_tail(a, a)) == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * a)), abs=1e-7)


@pytest.mark.parametrize("n", [10, 1e3, 2001, 1e5, 1e9, 1e10, 1e12])
def test_beta_is_symmetric(n):
    assert one(T.beta_share(0.5, n / 2, n / 2)) == pytest.approx(0.5, abs=1e-9)


def test_methods_agree_where_they_meet():
    for x in (9.9e3, 1e4, 1.01e4):
        assert one(T._gamma_series(np.array([1e4]), np.array([x]))) == pytest.approx(one(T._gamma_uniform(np.array([1e4]), np.array([x]))), abs=1e-10)
    for a, b, x in ((1500.0, 2500.0, 0.36), (1500.0, 2500.0, 0.4), (5000.0, 1200.0, 0.8)):
        assert one(T._beta_wide(*map(np.array, ([x], [a], [b])))) == pytest.approx(one(T._beta_fraction(*map(np.array, ([x], [a], [b])))), abs=1e-9)
    for b in (0.5, 3.0, 900.0):
        x = b * 1.02 / 1e7
        assert one(T._beta_steep(*map(np.array, ([x], [b], [1e7])))) == pytest.approx(1 - one(T._beta_fraction(*map(np.array, ([1 - x], [1e7], [b])))), abs=1e-7)


@pytest.mark.parametrize("df", [1e6, 1e7, 1e9, 1e12])
def test_t_tends_to_normal(df):
    z = NormalDist().inv_cdf(0.975)
    got = one(T._f_tail(np.array([z * z]), np.array([1.0]), np.array([df])))
    # first term of the expansion in 1 / df
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    assert got == pytest.approx(0.05 + density * z * (z * z + 1) / (2 * df), abs=1e-9)


def test_binomial_interval_of_a_large_study():
    low = one(T.beta_point(0.025, np.array([5e9]), np.array([5e9 + 1])))
    assert low == pytest.approx(0.5 - 1.959964 * math.sqrt(0.25 / 1e10), abs=1e-9)
