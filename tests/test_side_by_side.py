"""Independent boosters are fitted side by side; bins come from one text."""

import threading

import numpy as np
from pyspark.sql import functions as F

from tabstrata.learners import boosting as BO
from tabstrata.learners.base import LinearModel, score
from tabstrata.plans import stack as ST


def test_mean_scores_fit_boosters_side_by_side(spark, monkeypatch):
    df = spark.range(12).select("id", (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    together = threading.Barrier(2, timeout=60)  # passed by two callers at a time only

    def out_of_fold(self, df, label, fold, k_folds, prefix):
        together.wait()
        return df.select("*", *[F.lit(1 / 3).alias(f"{prefix}_{c}") for c in range(3)])

    monkeypatch.setattr(ST.Pipeline, "out_of_fold", out_of_fold)
    got = ST.mean_scores(df, "y", {"a": (["id"], []), "b": (["id"], [])}, 3, k_folds=2).toPandas()
    assert sorted(zip(got.model, got.feature_set, got.fold)) == sorted((m, s, f) for m in ST.BASELINES for s in "ab" for f in (0, 1))
    assert np.allclose(got.log_loss, np.log(3))


def test_bins_are_asked_for_in_one_text(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 0.1).alias("a b"), F.col("id").cast("double").alias("c"))
    made, lit = [], F.lit
    monkeypatch.setattr(F, "lit", lambda v: made.append(v) or lit(v))
    for most in (BO.EXACT_BIN_ROWS, 100):
        monkeypatch.setattr(BO, "EXACT_BIN_ROWS", most)
        binner = BO.Binner(["a b", "c"], [], 256).fit(df)
        assert len(made) < 10 and len(binner.cuts["c"]) == 255
        assert np.allclose(binner.cuts["c"], np.arange(1, 256) / 256 * 999, atol=1.0)


def test_scores_go_back_as_columns(spark):
    df = spark.range(50).select("id", (F.col("id") * 0.1).alias("x"))
    model = LinearModel(["x"], np.array([[1.0], [-1.0]]), np.array([0.5, 0.0]), "log_loss")
    scored = score(df, [model], "p")
    assert "array" not in scored._jdf.queryExecution().analyzed().toString().lower()
    got = scored.orderBy("id").toPandas()
    assert np.allclose(got[["p_0", "p_1"]], model.predict_array(got[["x"]].to_numpy()))
