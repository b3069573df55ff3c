"""Calibrated learners out of fold: shared folds and preprocessing give what fitting fold by fold gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.operators import fold_prep
from tabstrata.operators.folds import complement_folds, stratified_folds
from tabstrata.plans.registry import LEARNERS
from tabstrata.sources.tables import CATEGORIES, NUMERIC


def test_folds_of_all_complements_from_one_ranking(spark):
    df = spark.range(4_000).select("id", (F.col("id") % 7 % 3).cast("int").alias("y"), (F.hash("id") % 3 + 3).cast("int").alias("f"))
    df = df.withColumn("f", F.col("f") % 3)
    found = {r["id"]: r for r in complement_folds(df, "id", "y", "f", 3, 5, 42, "c{j}", digits=1).collect()}
    assert len(found) == 4_000
    for j in range(3):
        expected = {r["id"]: r["e"] for r in stratified_folds(df.where(F.col("f") != j), "id", "y", 5, 42, "e").collect()}
        assert {i: r[f"c{j}"] for i, r in found.items() if r[f"c{j}"] is not None} == expected


@pytest.mark.parametrize("name, params", [("ridge", dict(alpha=1.0, fit_intercept=True)), ("linear_svc", dict(penalty="l2", C=0.1, tol=1e-3))])
def test_shared_passes_score_as_fold_by_fold(spark, small, monkeypatch, name, params):
    from tabstrata.plans.fixtures import training_frame

    df = training_frame(spark, small, k=2)
    pipe = LEARNERS[name].build(params, 3, NUMERIC, CATEGORIES)
    encoded, real = [], fold_prep.class_encoded
    monkeypatch.setattr(fold_prep, "class_encoded", lambda *a: encoded.append(1) or real(*a))
    found = pipe.out_of_fold(df, "class_encoded", "fold", 2, "p").toPandas().sort_values("id")
    assert len(encoded) == 1  # once, not once a fold
    names = ["p_0", "p_1", "p_2"]
    for j in range(2):
        expected = pipe.fold_scored(df, "class_encoded", "fold", j, "p").toPandas().sort_values("id")
        np.testing.assert_allclose(found[found["fold"] == j][names], expected[names], atol=1e-6)


def test_small_lookups_start_no_tasks(spark):
    from tabstrata.runtime import LOCAL_ROWS, held, lookup_join

    keys = spark.range(5).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.array(F.col("id") / 3, F.lit(None)).alias("v"))
    assert "LocalTableScan" in held(keys)._jdf.queryExecution().executedPlan().toString()
    assert held(keys).schema == keys.schema and sorted(map(str, held(keys).collect())) == sorted(map(str, keys.collect()))
    assert held(spark.range(LOCAL_ROWS + 1)).count() == LOCAL_ROWS + 1
    df = spark.range(20).select((F.col("id") % 5).alias("a")).select(F.when(F.col("a") > 0, F.col("a")).alias("k"))
    joined = lookup_join(df, keys, ["k"], null_safe=True)
    assert joined.count() == 20 and joined.where("v is null").count() == 0
