"""SGD over shards of hashed rows: the same bits under every partitioning, plain steps, copies, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.learners.linear import AveragedSGD

X = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(3000):
        y = int(rng.choice(3, p=[0.5, 0.3, 0.2]))
        data.append((i, y, i % 4, float(rng.normal(y, 1.0)), float(rng.normal(-y, 1.0))))
    # a third of all rows are copies of one
    data += [(3000 + i, 1, 2, 0.5, 0.25) for i in range(1500)]
    df = spark.createDataFrame(data, "id long, y int, fold int, a double, b double").persist()
    df.count()
    return df


def coefficients(df, fold=None, k_folds=1, **kw):
    sgd = AveragedSGD(3, alpha=1e-3, max_iter=3, **kw)
    return np.stack([np.column_stack([m.coef, m.intercept]) for m in sgd.fit_folds(df, X, "y", fold, k_folds)])


@pytest.mark.parametrize("kw", [dict(penalty="elasticnet", average=True), dict(loss="hinge", shard_rows=200, learning_rate="invscaling")])
def test_same_bits_for_every_partitioning(spark, rows, kw):
    first = coefficients(rows.coalesce(1), "fold", 4, **kw)
    for n in (4, 8):
        assert (coefficients(rows.repartition(n, F.rand(n)), "fold", 4, **kw) == first).all()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert (coefficients(rows, "fold", 4, **kw) == first).all()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_shards_hold_every_row_and_split_copies(spark, rows):
    from tabstrata.runtime import Steps

    steps = Steps(spark, "rows")
    dealt = AveragedSGD(3)._deal(rows, X, "y", "fold", 10, steps).persist()
    assert dealt.agg(F.sum("times")).first()[0] == rows.count()
    copies = dealt.where("x0 = 0.5 and x1 = 0.25").select("shard", "times").collect()
    assert sorted(r["shard"] for r in copies) == list(range(10)) and {r["times"] for r in copies} == {150}
    places = dealt.select("shard", F.spark_partition_id().alias("part")).distinct()
    assert places.count() == 10
    dealt.unpersist()
    steps.close()


def test_one_epoch_equals_plain_steps(spark):
    """With one row a batch, each shard is the textbook loop over its rows; their mean is the result."""
    rng = np.random.default_rng(5)
    data = [(int(y), float(x)) for y, x in zip(rng.integers(0, 2, 60), rng.normal(size=60))]
    df = spark.createDataFrame(data, "y int, a double")
    sgd = AveragedSGD(2, loss="log_loss", penalty="l2", alpha=0.01, learning_rate="constant", eta0=0.1, class_weight=None, batch=1, max_iter=1)
    got = sgd.fit(df, ["a"], "y")
    from tabstrata.runtime import Steps

    steps = Steps(spark, "rows")
    dealt = AveragedSGD(2)._deal(df, ["a"], "y", None, 8, steps).collect()
    steps.close()
    total = np.zeros((2, 2))
    for shard in {r["shard"] for r in dealt}:
        w, n = np.zeros((2, 2)), 0
        for r in [r for r in dealt if r["shard"] == shard]:
            x = np.array([r["x0"], 1.0])
            sign = np.where(np.arange(2) == r["y"], 1.0, -1.0)
            pull = sign / (1.0 + np.exp(sign * (w @ x)))
            w[:, 0] *= 1.0 - 0.1 * 0.01
            w = w + 0.1 * pull[:, None] * x[None, :]
            n += 1
        total += w * n
    assert np.allclose(np.column_stack([got.coef, got.intercept]), total / 60, atol=1e-12)


def test_no_rows_are_refused(rows):
    with pytest.raises(ValueError):
        AveragedSGD(3, max_iter=1).fit(rows.limit(0), X, "y")
