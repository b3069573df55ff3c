"""One policy for missing values, sums that keep NaN, moments that keep their digits, odd selections."""

import numpy as np
import pytest

from tabstrata.learners import forests, mllib, perceptron
from tabstrata.learners.base import partial_sums, require_complete
from tabstrata.learners.boosting import DEPTHWISE, HistogramBooster
from tabstrata.learners.knn import SvdKnn
from tabstrata.learners.linear import AveragedSGD, ElasticNetLogistic, SquaredHingeSVC
from tabstrata.learners.moments import MomentLearner, fold_moments
from tabstrata.operators.profile import box_stats, histogram
from tabstrata.operators.selection import ColumnSelector
from tabstrata.runtime import lookup_join

LEARNERS = {
    "lda": lambda: MomentLearner("lda", 2),
    "ridge": lambda: MomentLearner("ridge", 2),
    "svc": lambda: SquaredHingeSVC(2, max_iter=2),
    "sgd": lambda: AveragedSGD(2, max_iter=1),
    "logistic": lambda: ElasticNetLogistic(2, max_iter=2),
    "spark_logistic": lambda: mllib.SparkLogistic(2, max_iter=2),
    "forest": lambda: forests.RandomForest(2, n_estimators=1),
    "perceptron": lambda: perceptron.Perceptron(2, (2,), max_iter=1),
    "knn": lambda: SvdKnn(2, n_components=1, n_neighbors=1),
}


def rows(n=120, shift=0.0):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 2)) + shift
    return [(i, float(a), float(b), int(a + b > 2 * shift)) for i, (a, b) in enumerate(x)]


SCHEMA = "id bigint, a double, b double, y int"


@pytest.mark.parametrize("name", list(LEARNERS))
@pytest.mark.parametrize("bad", [(500, None, 1.0, 0), (500, float("nan"), 1.0, 0), (500, 1.0, 1.0, None), (500, 1.0, 1.0, 7)])
def test_incomplete_rows_are_refused(spark, name, bad):
    df = spark.createDataFrame([*rows(), bad], SCHEMA).repartition(3)
    with pytest.raises(ValueError):
        LEARNERS[name]().fit(df, ["a", "b"], "y")


def test_boosting_refuses_incomplete_rows_too(spark):
    df = spark.createDataFrame([*rows(), (500, None, 1.0, 0)], SCHEMA)
    with pytest.raises(ValueError):
        HistogramBooster(2, DEPTHWISE, ["a", "b"], []).fit(df, "y")


@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_a_nan_stays_in_the_sum_of_every_partitioning(spark, partitions):
    df = spark.createDataFrame([*rows(), (500, None, 1.0, 0)], SCHEMA).repartition(partitions)

    def add(pdf, acc):
        acc[0] += len(pdf)
        acc[1] += pdf["a"].to_numpy(dtype=float).sum()

    total = partial_sums(df, ["a"], add, 2)
    assert total[0] == 121 and np.isnan(total[1])


@pytest.mark.parametrize("name", ["lda", "ridge", "svc", "logistic"])
def test_partitioning_does_not_change_a_fit(spark, name):
    data = rows()
    models = [
        LEARNERS[name]().fit(spark.createDataFrame(data, SCHEMA).repartition(p), ["a", "b"], "y") for p in (1, 4, 8)
    ]
    for m in models[1:]:
        assert np.allclose(m.coef, models[0].coef, rtol=1e-8) and np.allclose(m.intercept, models[0].intercept, rtol=1e-8)


def test_moments_far_from_zero_keep_their_digits(spark):
    near, far = rows(3000), rows(3000, 1e9)
    for width in (2, 10):
        names = [f"x{i}" for i in range(width)]
        got = []
        for data in (near, far):
            wide = [(*[r[1 + i % 2] * (1 + i // 2) for i in range(width)], r[3]) for r in data]
            df = spark.createDataFrame(wide, ", ".join(f"{c} double" for c in names) + ", y int")
            got.append(fold_moments(df, names, "y", 2)[0].scatter())
            x, y = np.array([w[:-1] for w in wide]), np.array([w[-1] for w in wide])
            want = np.array([(x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)])
            assert np.allclose(got[-1], want, rtol=1e-5)


def test_means_of_complete_features(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    data = np.array([r[1:3] for r in rows()])
    assert np.allclose(require_complete(df, ["a", "b"], "y", 2), data.mean(axis=0))
    assert require_complete(df.limit(0), ["a"], "y", 2).tolist() == [0.0]


def test_numpy_masks_and_positions():
    names = ["p", "q", "r"]
    assert ColumnSelector(mask=np.array([True, False, True])).resolve(names) == ["p", "r"]
    assert ColumnSelector(features=np.array([2, 0])).resolve(names) == ["r", "p"]
    with pytest.raises(TypeError):
        ColumnSelector(features=[True, False, True])
    with pytest.raises(TypeError):
        ColumnSelector(mask=np.array([1, 0, 1])).resolve(names)


def test_columns_of_nulls_only(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    assert histogram(df, "v").count() == 0
    assert box_stats(df, "v").count() == 0
    assert box_stats(df, "v", by="id").count() == 0


def test_equal_rows_of_a_hot_key_are_spread_and_kept(spark):
    big = spark.createDataFrame([("k", 1)] * 5000 + [("z", 2)], "key string, v int")
    table = spark.createDataFrame([("k", 10), ("m", 11)], "key string, w int")
    got = lookup_join(big, table, ["key"], limit=0)
    assert got.count() == 5001 and got.where("w = 10").count() == 5000 and got.where("w is null").count() == 1
