"""Rows that many models train on are cached once, with each model's features read from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.learners import base as BA
from tabstrata.plans.pipeline import Pipeline
from tabstrata.plans.registry import LEARNERS
from tabstrata.sources.tables import CATEGORIES, NUMERIC

PARAMS = {"logistic_regression": dict(C=1.0, l1_ratio=0.5), "linear_svc": dict(penalty="l2", C=0.1, tol=1e-3)}


@pytest.mark.parametrize("name", list(PARAMS))
def test_all_fold_models_share_one_cached_table(spark, small, monkeypatch, name):
    from tabstrata.plans.fixtures import training_frame

    df = training_frame(spark, small, k=2)
    pipe = LEARNERS[name].build(PARAMS[name], 3, NUMERIC, CATEGORIES)
    expected = [pipe.fold_scored(df, "class_encoded", "fold", j, "p").toPandas() for j in range(2)]
    made, closed, real, close = [], [], BA.ModelRows.__init__, BA.ModelRows.close
    monkeypatch.setattr(BA.ModelRows, "__init__", lambda self, *a: made.append(self) or real(self, *a))
    monkeypatch.setattr(BA.ModelRows, "close", lambda self: closed.append(self) or close(self))
    monkeypatch.setattr(Pipeline, "fold_scored", None)
    found = pipe.out_of_fold(df, "class_encoded", "fold", 2, "p").toPandas().sort_values("id")
    assert len(made) == 1 and closed == made and len(made[0].sets) == 2  # no model of all rows either
    for j in range(2):
        want = expected[j].sort_values("id")
        np.testing.assert_allclose(found[found["fold"] == j][["p_0", "p_1", "p_2"]], want[["p_0", "p_1", "p_2"]], atol=1e-6)


def test_rows_of_no_part_count_nowhere(spark):
    df = spark.range(40).select((F.col("id") * 0.5).alias("a"), (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") < 30, F.col("id") % 3).alias("f"))
    rows = BA.ModelRows(df, [["a"]], "y", 2, [F.col("f"), F.lit(-2)])
    try:
        assert rows.counts(0, 3).tolist() == [[5, 5], [5, 5], [5, 5], [0, 0]]
        assert rows.counts(1, 3).tolist() == [[0, 0], [0, 0], [0, 0], [20, 20]]
        blocks = [b for batch in rows.frame.toArrow().to_batches() for b in BA.rows_of(batch)]
        for b in blocks:
            y, f, kept = BA.part_of(b, 0, rows=True)
            assert (f >= 0).all() and BA.scaled_rows(b, rows.scales[0], kept).shape == (2, len(y))
    finally:
        rows.close()
    with pytest.raises(ValueError, match="null or NaN"):
        BA.ModelRows(df.withColumn("a", F.when(F.col("a") > 3, F.col("a"))), [["a"]], "y", 2, [])


def test_fits_run_side_by_side_on_few_rows_only(spark):
    from tabstrata.runtime import ROWS_AT_ONCE, side_by_side

    cores = spark.sparkContext.defaultParallelism
    assert side_by_side(spark.range(0), 4) == side_by_side(spark.range(1000), 4) == 4
    assert side_by_side(spark.range(cores * ROWS_AT_ONCE // 2), 4) == 2
    assert side_by_side(spark.range(3 * cores * ROWS_AT_ONCE), 4) == 1
