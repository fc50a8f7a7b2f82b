"""Split paths give the same rows as the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators.ordered import ordered_scan, quantiles
from strataline.operators.skew import attach_size, full_join


def sample(spark, n=200):
    rng = random.Random(3)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < .5 else rng.choice("abcdefgh")
        out.append((None if rng.random() < .05 else key, rng.randint(0, 12), i, float(rng.randint(0, 9)) if rng.random() > .1 else None))
    return spark.createDataFrame(out, "k string, d int, id int, v double")


def scan(df, by, **more):
    return ordered_scan(df, by, ["d", "-id"], row_number="rn", dense_rank="dr", dense_on=["d"],
                        lag={"pv": "v", "pd": "d"}, running={"rs": "v"}, total={"tv": "v"}, **more)


@pytest.mark.parametrize("by", [["k"], []])
def test_pieces_equal_windows(spark, small_groups, by):
    df = sample(spark)
    split = {r["id"]: r for r in scan(df, by).collect()}
    plain = {r["id"]: r for r in scan(df, by, bounded=True).collect()}
    assert split == plain and len(split) == 200


def test_quantiles_match_numpy(spark, small_groups):
    df = sample(spark)
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", {"q1": .25, "q2": .5, "q3": .75}).collect()}
    pdf = df.toPandas()
    for key, part in pdf[pdf.v.notna()].groupby("k"):
        assert np.allclose([got[key][q] for q in ("q1", "q2", "q3")],
                           np.percentile(part.v, [25, 50, 75]))


def test_attach_keeps_every_row(spark, small_groups):
    df = sample(spark)
    pdf = df.toPandas()
    sizes = pdf.k.value_counts(dropna=False).to_dict()
    got = attach_size(df, ["k"]).collect()
    assert len(got) == 200
    assert all(r["n"] == (sizes[r["k"]] if r["k"] is not None else int(pdf.k.isna().sum())) for r in got)


@pytest.mark.parametrize("limit", ["1000", "1"])
def test_full_join_like_outer_merge(spark, limit):
    spark.conf.set("strataline.group_rows", limit)
    try:
        check_full_join(spark)
    finally:
        spark.conf.unset("strataline.group_rows")


def check_full_join(spark):
    x = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    y = spark.createDataFrame([(2, "B"), (2, "BB"), (3, "C"), (None, "N")], "k int, v string")
    key = lambda t: tuple(str(a) for a in t)
    got = sorted(((r["k"], r["v.x"], r["v.y"]) for r in
                  full_join(x, y, ["k"], na_matches=True).withColumnsRenamed({}).collect()), key=key)
    assert got == sorted([(1, "a", None), (2, "b", "B"), (2, "b", "BB"), (3, None, "C"), (None, "n", "N")], key=key)
    never = full_join(x, y, ["k"], na_matches=False)
    assert never.count() == 6
    assert never.filter(F.col("k").isNull()).count() == 2
