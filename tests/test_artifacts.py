"""Whole pipelines stored and loaded: every learner, raw rows with categories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.plans.registry import LEARNERS
from tabstrata.sources import artifacts

K = 3
PARAMS = {
    "xgboost": dict(max_depth=3, learning_rate=0.3, n_estimators=2, subsample=0.9, colsample_bytree=0.9, gamma=0.0, reg_alpha=0.1, reg_lambda=1.0),
    "lightgbm": dict(
        num_leaves=5, max_depth=4, learning_rate=0.3, lambda_l1=0.1, lambda_l2=1.0, feature_fraction=1.0, bagging_fraction=0.9,
        bagging_freq=1, min_child_samples=10,
    ),
    "catboost": dict(auto_class_weights="Balanced", depth=3, min_data_in_leaf=5, learning_rate=0.3, l2_leaf_reg=3.0, bagging_temperature=1.0, rsm=1.0),
    "hist_gradient_boosting": dict(learning_rate=0.3, max_depth=3, min_samples_leaf=20, l2_regularization=1.0, max_bins=64),
    "extra_tree": dict(n_estimators=3, max_depth=4, min_samples_leaf=5, max_features=0.5, criterion="entropy"),
    "random_forest": dict(
        n_estimators=3, max_depth=4, min_samples_split=10, min_samples_leaf=5, max_features="sqrt", criterion="gini", bootstrap=True,
        class_weight="balanced_subsample",
    ),
    "logistic_regression": dict(C=1.0, l1_ratio=0.5),
    "ridge": dict(alpha=1.0, fit_intercept=True),
    "sgdclassifier": dict(loss="log_loss", penalty="l2", alpha=1e-3),
    "linear_svc": dict(penalty="l2", C=0.1, tol=1e-2),
    "mlp": dict(n_layers=2, hidden_0=8, hidden_1=4, activation="tanh", alpha=1e-3, learning_rate_init=0.05, tol=1e-3),
    "lda": dict(solver="svd"),
    "qda": dict(reg_param=0.1, tol=1e-4),
    "trunsvd_knn": dict(n_components=2, n_neighbors=3, weights="distance", p=2, metric="minkowski"),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.8)
    color = [None if i % 50 == 0 else f"c{int(v)}" for i, v in enumerate(rng.integers(0, 4, 500) + y)]
    data = [(i, *map(float, r), c, "xy"[int(r[2] > 0)], int(t)) for i, (r, c, t) in enumerate(zip(x, color, y))]
    return spark.createDataFrame(data, "id long, alpha double, u double, z double, color string, side string, y int").persist()


def test_parameters_for_every_learner():
    assert set(PARAMS) == set(LEARNERS)


@pytest.mark.parametrize("name", list(PARAMS))
def test_a_fresh_session_scores_raw_rows_alike(spark, rows, tmp_path, name):
    pipe = LEARNERS[name].build(PARAMS[name], K, ["alpha", "u", "z"], ["color", "side"], 3)
    fitted, path = pipe.fit(rows, "y"), str(tmp_path / name)
    assert not artifacts.exists(spark, path)
    artifacts.save_model(spark, fitted, path)
    assert artifacts.exists(spark, path)
    raw = rows.drop("y").unionByName(rows.drop("y").limit(1).withColumn("color", F.lit("new")).withColumn("id", F.lit(900).cast("long")))
    want = fitted.score(raw, "p").orderBy("id").toPandas()
    other = spark.newSession()
    again = artifacts.load_model(other, path)
    raw.write.parquet(str(tmp_path / "raw"))
    got = again.score(other.read.parquet(str(tmp_path / "raw")), "p").orderBy("id").toPandas()
    names = [f"p_{c}" for c in range(K)]
    assert len(got) == 501 and np.allclose(got[names], want[names], atol=1e-12)
    assert np.allclose(got[names].sum(axis=1), 1)


def test_one_row_per_tree_and_versions(spark, rows, tmp_path):
    pipe = LEARNERS["random_forest"].build(PARAMS["random_forest"], K, ["alpha", "u", "z"], [], 3)
    path = artifacts.save_model(spark, pipe.fit(rows, "y"), str(tmp_path / "f"))
    params = spark.read.parquet(f"{path}/params")
    assert params.where("kind = 'PackedTree'").count() == 3
    old = str(tmp_path / "old")
    params.where("at != 'version'").write.parquet(f"{old}/params")
    with pytest.raises(ValueError):
        artifacts.load_model(spark, old)
    with pytest.raises(TypeError):
        artifacts.save_model(spark, object(), str(tmp_path / "x"))
