"""Learners over many rows of few vectors work on the different vectors and say what they say on the rows."""

import numpy as np

from pyspark.sql import functions as F

from strataline.operators import models


def frame(spark, n=3000):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (n, 4))
    p = np.where(x[:, 0] == 1, .8, .25) + .1 * x[:, 1]
    y = (rng.random(n) < p).astype(int)
    return models.assemble(spark.createDataFrame([(i, int(y[i]), *map(int, x[i])) for i in range(n)], "id int, y int, a int, b int, c int, d int"), list("abcd"))


def test_learners_read_the_different_vectors(spark, monkeypatch):
    rows, read = frame(spark), {}
    monkeypatch.setattr(models, "FOREST_ROWS", 100, raising=False)
    for name in ("logistic", "boosting"):
        def noted(train, *args, real=getattr(models, name), name=name, **more):
            read[name] = train.count()
            return real(train, *args, **more)
        monkeypatch.setattr(models, name, noted)
    monkeypatch.setattr(models, "forest", lambda train, *_: 1 / 0)
    out = models.compare_on_vectors(rows, "id", "y", 4, trees=10, stages=5)
    assert set(read) == {"logistic", "boosting"} and max(read.values()) <= 32
    told = {r["model"]: r["n"] for r in out.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(told) == 4 and len(set(told.values())) == 1
    forest = out.filter("model = 'Random_Forest'").join(rows.drop("y"), "id").select("a", "prediction").distinct().collect()
    assert {(r["a"], r["prediction"]) for r in forest} == {(0, 0), (1, 1)}


def test_weights_stand_for_rows(spark):
    rows = frame(spark)
    counted = models.counted_vectors(rows, "y")
    assert counted.agg(F.sum("__rows")).first()[0] == rows.count()
    a, b = models.logistic(rows, "y"), models.logistic(counted, "y", weight="__rows")
    assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6) and abs(a.intercept - b.intercept) < 1e-6
    scores = [{tuple(r["features"].toArray()): r["probability"][1] for r in m.transform(counted).collect()}
              for m in (models.boosting(rows, "y", 8), models.boosting(counted, "y", 8, weight="__rows"))]
    assert scores[0].keys() == scores[1].keys() and max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-9


def test_votes_are_those_of_a_forest_on_the_rows(spark):
    rows = frame(spark)
    counted = models.counted_vectors(rows, "y")
    wanted = rows.groupBy("features").agg(F.count(F.lit(1)).alias("__rows")).withColumn("__vector", F.col("features").cast("string"))
    plain = {str(r["features"]): r["probability"][1] for r in models.forest(rows, "y", 100).transform(wanted).collect()}
    names = {r["__vector"]: str(r["features"]) for r in wanted.collect()}
    votes = {names[r["__vector"]]: (r["score"], r["prediction"]) for r in models.forest_votes(counted, wanted, "y", 100).collect()}
    assert votes.keys() == plain.keys() and len(votes) == 16
    # two forests on the rows with other seeds differ by up to .027 in a score and .001 in the mean
    assert max(abs(votes[k][0] - plain[k]) for k in plain) < .05
    assert abs(np.mean([votes[k][0] - plain[k] for k in plain])) < .005
    assert all(p == (s > .5) for s, p in votes.values())
    again = {names[r["__vector"]]: r["score"] for r in models.forest_votes(counted, wanted, "y", 100).collect()}
    assert again == {k: s for k, (s, _) in votes.items()}
