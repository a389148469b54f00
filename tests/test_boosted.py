"""Boosted linear models against dense numpy fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.operators import boosted

R = np.random.default_rng(17)
X = R.normal(size=(150, 4))
X[:, 3] = 0  # a feature that never differs
Y = np.clip(np.rint(2.5 + X[:, 0] - 0.5 * X[:, 1] + 0.3 * R.normal(size=150)), 1, 4)
W = 0.5 + R.random(150)


def rows(spark):
    data = [(a.tolist(), float(b), float(w)) for a, b, w in zip(X, Y, W, strict=True)]
    return spark.createDataFrame(data, "features array<double>, label double, weight double").repartition(3)


def derivatives(kind, p):
    """(gradients, Hessians) by output, plainly."""
    y, w = Y, W
    if kind == "squared":
        return (p - y[:, None]) * w[:, None], np.repeat(w[:, None], 1, axis=1)
    k = np.arange(1, p.shape[1] + 1)
    if kind == "softmax":
        q = np.exp(p - p.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        return (q - (y[:, None] == k)) * w[:, None], 2 * q * (1 - q) * w[:, None]
    if kind == "cocr":
        c = np.abs((y[:, None] - 1 - k) ** 2 - (y[:, None] - 1 - (k - 1)) ** 2)
        return 2 * c * (p - (y[:, None] - 1 >= k)) * w[:, None], 2 * c * w[:, None]
    s = np.where(y[:, None] > k, 1.0, -1.0)
    c = np.abs((s - k) ** 2 - (s - k - 1) ** 2) * w[:, None]
    e = np.exp(s * p)
    return -c * s / (1 + e), c * e / (1 + e) ** 2


def dense(kind, outputs, rounds, eta, l1, l2, l2_bias, base):
    a = np.column_stack([np.ones(len(X)), X])
    w = np.zeros((outputs, a.shape[1]))
    for _ in range(rounds):
        g, h = derivatives(kind, a @ w.T + base)
        for k in range(outputs):
            moved = np.zeros(len(X))  # the change of this output's predictions in the round
            for j in range(a.shape[1]):
                bend = (h[:, k] * a[:, j] ** 2).sum()
                if bend < 1e-12:
                    continue
                slope = ((g[:, k] + h[:, k] * moved) * a[:, j]).sum()
                keep, pull = (l2_bias, 0.0) if j == 0 else (l2, l1)
                # the least of slope * d + bend * d^2 / 2 + keep * (w + d)^2 / 2 + pull * |w + d|
                target = bend * w[k, j] - slope
                target = 0.0 if abs(target) <= pull else (target - np.sign(target) * pull) / (bend + keep)
                d = eta * (target - w[k, j])
                w[k, j] += d
                moved += d * a[:, j]
    return w


@pytest.mark.parametrize("kind,outputs", [("squared", 1), ("softmax", 4), ("ebc", 3), ("cocr", 3)])
def test_weights_equal_a_dense_fit(spark, kind, outputs):
    for l1, l2, l2_bias in ((0.0, 1.0, 0.0), (8.0, 0.5, 2.0)):
        model = boosted.fit(rows(spark), kind, rounds=4, eta=0.7, l1=l1, l2=l2, l2_bias=l2_bias)
        want = dense(kind, outputs, 4, 0.7, l1, l2, l2_bias, 0.5 if kind == "squared" else 0.0)
        assert model.weights.shape == want.shape and np.allclose(model.weights, want, atol=1e-9)
    assert (np.abs(model.weights[:, 1:]) < 1e-12).any()  # the penalty on sizes leaves features out


def test_many_rounds_end_at_the_least_squares(spark):
    model = boosted.fit(rows(spark), "squared", rounds=400, eta=1.0, l2=2.0, base=0.0)
    a = np.column_stack([np.ones(len(X)), X])
    keep = np.diag([0.0, 2.0, 2.0, 2.0, 2.0])
    want = np.linalg.solve(a.T @ (a * W[:, None]) + keep, a.T @ (W * Y))
    assert np.allclose(model.weights[0], want, atol=1e-8)


def test_ratings_follow_labels(spark):
    for kind in boosted.OBJECTIVES:
        model = boosted.fit(rows(spark), kind, rounds=8, eta=0.5 if kind != "soft_kappa" else 0.02)
        got = boosted.predict(rows(spark), model, kind).toPandas()
        assert np.corrcoef(got.label, got.prediction)[0, 1] > 0.8, kind


def test_odd_tables(spark):
    for kind in boosted.OBJECTIVES:
        model = boosted.fit(rows(spark).limit(0), kind, rounds=2)
        assert not model.weights.any()
        assert boosted.predict(rows(spark).limit(0), model, kind).collect() == []
    odd = rows(spark).unionByName(spark.createDataFrame([(None, 1.0, 1.0), ([1.0, None, 1.0, 1.0], 1.0, 1.0), ([float("nan")] * 4, 1.0, 1.0), ([1.0] * 4, None, 1.0)], "features array<double>, label double, weight double"))
    same = [boosted.fit(df, "squared", rounds=2).weights for df in (odd, rows(spark))]
    assert np.allclose(*same)
    with pytest.raises(ValueError):
        boosted.fit(rows(spark).withColumn("features", F.array_repeat(F.lit(1.0), 3000)), "squared")


def test_refit_gives_raw_rank_and_rating(spark):
    from pyspark.ml.functions import array_to_vector

    from sievemill.operators import learners

    known = rows(spark).withColumn("id", F.monotonically_increasing_id()).withColumn("x", F.col("features")).withColumn("features", array_to_vector("x"))
    test = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(R.normal(size=(60, 4)))], "id long, x array<double>")
    got = learners.refit("reg_linear", known, test, {"rounds": 5}).toPandas().sort_values(["prediction", "id"]).reset_index(drop=True)
    model = boosted.fit(rows(spark), "squared", rounds=5)
    x = {r.id: np.array(r.x) for r in test.collect()}
    assert np.allclose(got.prediction, [0.5 + model.weights[0] @ np.append(1.0, x[i]) for i in got.id])
    assert got["rank"].tolist() == list(range(60))
    cuts = [np.mean(Y <= k) for k in (1, 2, 3)]
    starts, stops = [0, *(int(60 * c) for c in cuts[:2])], [max(0, int(60 * c - 1)) for c in cuts]
    want = [next((k + 1 for k in range(3) if starts[k] <= i < stops[k]), 4) for i in range(60)]
    assert got.score.tolist() == want
    assert learners.refit("reg_linear", known, test.limit(0), {"rounds": 5}).collect() == []
