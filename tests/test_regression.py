"""Grouped logistic fits and path models: numpy references, aliased columns, separation, hot keys, empty inputs."""

import numpy as np
import pytest

from strataline.operators import regression

from conftest import rows


def newton(y, X):
    beta = np.zeros(X.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ beta))
        beta = beta + np.linalg.solve((X.T * (p * (1 - p))) @ X, X.T @ (y - p))
    p = 1 / (1 + np.exp(-X @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv((X.T * (p * (1 - p))) @ X))), -2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


@pytest.fixture
def cohort(spark):
    rng = np.random.default_rng(1)
    out = []
    for key, n in (("a", 300), ("b", 80), (None, 60)):
        x, v = rng.normal(size=n).round(2), rng.integers(0, 2, n)
        y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 + 0.8 * x - 0.5 * v + 0.3 * x * v)))).astype(int)
        out += [(key, int(q), float(r), float(s)) for q, r, s in zip(y, x, v)]
    out += [("constant", k % 2, float(k % 5), 2.0) for k in range(40)]
    out += [("separated", int(k > 20), float(k), float(k % 2)) for k in range(40)]
    out += [("none", None, 1.0, 1.0), ("a", 1, None, 1.0)]
    return out, spark.createDataFrame(out, "key string, y int, x double, v double")


@pytest.mark.parametrize("limit", [None, 7])
def test_fits_by_key(spark, cohort, limit, request):
    if limit:
        request.getfixturevalue("small_groups")
    raw, df = cohort
    got = {(r["key"], r["term"]): r for r in rows(regression.logit_interaction(df, "y", "x", "v", ["key"]))}
    assert {k for k, _ in got} == {"a", "b", None, "constant", "separated"}
    for key in ("a", "b", None):
        own = np.array([r[1:] for r in raw if r[0] == key and None not in r[1:]], float)
        X = np.column_stack([np.ones(len(own)), own[:, 1], own[:, 2], own[:, 1] * own[:, 2]])
        beta, se, deviance = newton(own[:, 0], X)
        for k, term in enumerate(("(Intercept)", "x", "v", "x:v")):
            r = got[key, term]
            assert r["estimate"] == pytest.approx(beta[k], rel=1e-6) and r["std_error"] == pytest.approx(se[k], rel=1e-6)
            assert r["deviance"] == pytest.approx(deviance) and r["aic"] == pytest.approx(deviance + 8) and r["n"] == len(own) and r["note"] is None
    # v is constant: v and x:v are aliased with the intercept and x
    assert got["constant", "v"]["estimate"] is None and got["constant", "x:v"]["p_value"] is None and got["constant", "x"]["estimate"] is not None
    assert got["constant", "x"]["aic"] == pytest.approx(got["constant", "x"]["deviance"] + 4)
    assert got["separated", "x"]["note"] and got["separated", "x"]["deviance"] < 1e-6


def test_no_rows(spark, cohort):
    df = cohort[1]
    for by in ((), ("key",)):
        assert regression.logit_interaction(df.limit(0), "y", "x", "v", by).count() == 0
        assert regression.path_model(df.limit(0), {"y": ["x", "v"]}, by).count() == 0
    assert regression.logit_interaction(df.filter("key = 'none'"), "y", "x", "v").count() == 0


def test_aliased_columns():
    x = np.random.default_rng(0).normal(size=(200, 3)) + 1000
    X = np.column_stack([np.ones(200), x[:, 0], 2 * x[:, 0] - 5, x[:, 1], x[:, 0] + x[:, 1], x[:, 2]])
    assert regression.kept_columns(X.T @ X, 1e-11) == [0, 1, 3, 5]


def test_path_by_key(spark):
    rng = np.random.default_rng(2)
    raw = []
    for key in ("p", "q"):
        a, b = rng.normal(size=120), rng.normal(size=120)
        y = 0.5 * a - 0.2 * b + rng.normal(size=120)
        raw += [(key, *map(float, r), 4.0) for r in zip(y, a, b, a - 3 * b)]
    df = spark.createDataFrame(raw, "key string, y double, a double, b double, mix double, same double")
    got = {(r["key"], r["op"], r["rhs"]): r for r in rows(regression.path_model(df, {"y": ["same", "a", "b", "mix"]}, ["key"]))}
    assert len(got) == 10
    for key in ("p", "q"):
        own = np.array([r[1:4] for r in raw if r[0] == key])
        X = np.column_stack([np.ones(120), own[:, 1:]])
        beta, *_ = np.linalg.lstsq(X, own[:, 0], rcond=None)
        assert got[key, "~", "a"]["est"] == pytest.approx(beta[1]) and got[key, "~", "b"]["est"] == pytest.approx(beta[2])
        assert got[key, "~~", "y"]["est"] == pytest.approx(((own[:, 0] - X @ beta) ** 2).mean())
        assert got[key, "~", "mix"]["est"] is None and got[key, "~", "same"]["p_value"] is None
