"""What boosting keeps cached: two states of the margins, of the models that are asked for."""

import numpy as np
from dataclasses import replace

from pyspark.sql import functions as F

from tabstrata.learners import boosting as BO
from tabstrata.learners.base import rows_of
from tabstrata.plans.pipeline import Pipeline


def test_out_of_fold_keeps_two_states_of_fold_models_only(spark, monkeypatch):
    df = spark.range(0, 600, 1, 2).select(
        "id", (F.col("id") % 37 * 0.1).alias("a"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("fold")
    )
    df = df.withColumn("a", F.col("a") + F.col("y")).persist()
    df.count()
    spec = replace(BO.DEPTHWISE, rounds=6, max_depth=2, max_bins=16, checkpoint_every=100)
    kept, widths, real = [], set(), BO.HistogramBooster._grow
    persistent = spark.sparkContext._jsc.getPersistentRDDs
    start = set(persistent())

    def grow(self, state, *args, **kw):
        out = real(self, state, *args, **kw)
        widths.update(b.num_columns for batch in state.toArrow().to_batches() for b in rows_of(batch))
        kept.append(len(set(persistent()) - start))
        return out

    monkeypatch.setattr(BO.HistogramBooster, "_grow", grow)
    pipe = Pipeline(BO.HistogramBooster(3, spec, ["a"]), ["a"])
    scored = pipe.out_of_fold(df, "y", "fold", 2, "p").toPandas().sort_values("id")
    assert len(kept) == 6 and max(kept) <= 2
    assert widths == {1 + 2 * 3 + 4}  # bins, margins of two models, what a row brings along
    assert not set(persistent()) - start
    monkeypatch.setattr(BO.HistogramBooster, "_grow", real)
    models = BO.HistogramBooster(3, spec, ["a"]).fit_folds(df, "y", "fold", 2)
    assert len(models) == 3
    for j in range(2):
        rows = scored[scored["fold"] == j]
        assert np.array_equal(rows[["p_0", "p_1", "p_2"]], models[j].predict_array(rows[["a"]].to_numpy()))
    df.unpersist()
