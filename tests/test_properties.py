"""Properties over random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from strataline.operators import accuracy, agreement, joins
from strataline.operators.ordered import quantiles

quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
scores = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=4, max_size=30).filter(lambda x: len({b for _, b in x}) == 2)


@quick
@given(st.lists(st.sampled_from(["a", "b", "c"]), min_size=3, max_size=20).filter(lambda x: len(set(x)) > 1))
def test_identical_raters_have_kappa_one(spark, values):
    df = spark.createDataFrame([(v, v) for v in values], "x string, y string")
    got = rows(agreement.kappa(df, "x", "y"))[0]
    assert abs(got["kappa"] - 1) < 1e-12 and got["percent_agreement"] == 100


@quick
@given(scores)
def test_auc_ignores_monotone_changes(spark, data):
    df = spark.createDataFrame([(s, s ** 3 + 2 * s, y) for s, y in data], "s int, t int, y int")
    a, b = (rows(accuracy.auc(df, c, "y"))[0]["auc"] for c in ("s", "t"))
    wins = [(1.0 if p > n else .5 if p == n else 0.0) for p, y in data if y for n, z in data if not z]
    assert abs(a - b) < 1e-12 and abs(a - sum(wins) / len(wins)) < 1e-12


@quick
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.sampled_from(["a", "b", "a\nb"]))), max_size=8, unique_by=lambda x: x[0]))
def test_coalesce_join_is_idempotent(spark, data):
    df = spark.createDataFrame(data, "k int, note string")
    once = joins.coalesce_join(df, df, ["k"])
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(once) == sorted(data, key=str) == key(joins.coalesce_join(once, df, ["k"]))


@quick
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.floats(0, 1))
def test_quantiles_like_numpy(spark, values, p):
    import numpy as np
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = rows(quantiles(df, [], "v", {"q": p}))[0]
    assert abs(got["q"] - np.percentile(values, p * 100)) < 1e-9 and got["n"] == len(values)
