"""The perceptron's gradient against finite differences, and its properties as a learner."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.learners import perceptron as PE
from tabstrata.learners.base import score

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 0] > 1.2)  # no linear model tells these apart
    data = [(i, *map(float, r), int(c), i % 3) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, y int, fold int"), x, y


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_gradient_equals_finite_differences(activation):
    rng, sizes = np.random.default_rng(1), [3, 5, 4, 3]
    flat = rng.normal(size=sum(a * b for a, b in PE.shapes(sizes)))
    x, y = rng.normal(size=(20, 3)), rng.integers(0, 3, 20)
    _, g = PE.gradient(PE.layers(flat, sizes), x, y, activation)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (PE.gradient(PE.layers(flat + s * step, sizes), x, y, activation)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_same_result_for_every_partitioning_and_better_than_linear(rows, activation):
    df, x, y = rows
    learner = PE.Perceptron(3, (12,), activation, learning_rate_init=0.1, max_iter=40)
    models = [learner.fit(df.repartition(n), COLUMNS, "y") for n in (1, 4, 8)]
    for m in models[1:]:
        assert np.allclose(m.flat, models[0].flat, atol=1e-6)
    assert (models[0].predict_array(x).argmax(1) == y).mean() > 0.8
    assert np.allclose(models[0].predict_array(x).sum(1), 1)


def test_folds_together_equal_folds_apart_and_never_see_their_own(rows):
    df, x, _ = rows
    learner = PE.Perceptron(3, (6, 4), "tanh", alpha=0.01, learning_rate_init=0.05, max_iter=8)
    together = learner.fit_folds(df, COLUMNS, "y", "fold", 3)
    for j in range(3):
        apart = learner.fit(df.where(F.col("fold") != j), COLUMNS, "y")
        assert np.allclose(together[j].flat, apart.flat, atol=1e-8)
    flipped = df.withColumn("y", F.when(F.col("fold") == 1, 0).otherwise(F.col("y")))
    assert np.allclose(learner.fit_folds(flipped, COLUMNS, "y", "fold", 3)[1].flat, together[1].flat, atol=1e-8)
    got = score(df, together, "p", "fold").orderBy("id").toPandas()
    assert np.allclose(got.loc[got.fold == 0, "p_1"], together[0].predict_array(x[got.fold == 0])[:, 1])


def test_penalty_shrinks_weights_and_patience_stops(rows, monkeypatch):
    df, _, _ = rows
    free, tight = (PE.Perceptron(3, (6,), alpha=a, learning_rate_init=0.1, max_iter=15).fit(df, COLUMNS, "y") for a in (0.0, 300.0))
    assert (tight.flat**2).sum() < 0.7 * (free.flat**2).sum()
    calls, real = [], PE.partial_sums
    monkeypatch.setattr(PE, "partial_sums", lambda *a: calls.append(1) or real(*a))
    PE.Perceptron(3, (6,), learning_rate_init=0.1, tol=10.0, n_iter_no_change=3, max_iter=50).fit(df, COLUMNS, "y")
    assert len(calls) == 4  # the first is the best, three more are not better by ten
    with pytest.raises(ValueError):
        PE.Perceptron(3, activation="sigmoid")
