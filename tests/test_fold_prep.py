"""Preprocessing of all fold models at once against a fit for each fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.operators import fold_prep as FP
from tabstrata.operators.encode import MeanTargetEncoder, TargetEncoder
from tabstrata.operators.folds import hashed_folds
from tabstrata.operators.scale import ColumnComposer
from tabstrata.plans.pipeline import INNER_FOLDS, Pipeline
from tabstrata.plans.registry import LEARNERS


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)) * [1, 7] + [0, 3]
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 9)
    color = [None if i % 40 == 0 else f"c{min(int(v), 9)}" for i, v in enumerate(rng.exponential(2, 400))]
    data = [(i, float(a), float(b), c, "xy"[i % 2], int(t), i % 3) for i, ((a, b), c, t) in enumerate(zip(x, color, y))]
    data += [(900, 0.1, 0.2, "only in fold 1", "x", 0, 1)]
    return spark.createDataFrame(data, "id long, a double, b double, color string, side string, y int, fold int").persist()


@pytest.mark.parametrize("blend", ["ratio", "sigmoid"])
def test_mean_encodings(rows, blend):
    enc = MeanTargetEncoder(["color", "side"], blend=blend)
    got, names = FP.mean_encoded(rows, enc, "y", "fold", 3)
    for j in range(4):
        want = MeanTargetEncoder(["color", "side"], blend=blend).fit(rows.where(F.col("fold") != j), "y").transform(rows)
        a = got.orderBy("id").select(*names[j]).toPandas().to_numpy()
        b = want.orderBy("id").select("color_mean", "side_mean").toPandas().to_numpy()
        assert np.allclose(a, b, atol=1e-12)


@pytest.mark.parametrize("smooth", ["auto", 10.0])
def test_class_encodings_and_scales(rows, smooth):
    inner = hashed_folds(rows, "id", INNER_FOLDS, "inner", "__inner")
    got, names = FP.class_encoded(inner, TargetEncoder(["color", "side"], 3, smooth), "y", "fold", 3, "__inner", INNER_FOLDS)
    got, more = FP.scaled(got, ["a"], ["b"], "fold", 3)
    got = got.orderBy("id").toPandas()
    for j in range(4):
        comp = ColumnComposer(["color", "side"], ["a"], ["b"], 3, smooth)
        train = comp.fit_transform(inner.where(F.col("fold") != j), "y", "__inner", INNER_FOLDS).orderBy("id").toPandas()
        mine = [*names[j], *more[j]]
        assert np.allclose(got.loc[got.fold != j, mine], train[comp.features], atol=1e-9)
        if j < 3:
            held = comp.transform(rows.where(F.col("fold") == j)).orderBy("id").toPandas()
            assert np.allclose(got.loc[got.fold == j, mine], held[comp.features], atol=1e-9)


@pytest.mark.parametrize("name,params", [
    ("extra_tree", dict(n_estimators=3, max_depth=4, min_samples_leaf=5, max_features=0.6, criterion="gini")),
    ("mlp", dict(n_layers=1, hidden_0=6, activation="tanh", alpha=1e-3, learning_rate_init=0.05, tol=1e-3)),
])
def test_out_of_fold_in_shared_passes(rows, name, params, monkeypatch):
    pipe = LEARNERS[name].build(params, 3, ["a", "b"], ["color", "side"], 6)
    assert pipe.parallel_folds
    monkeypatch.setattr(Pipeline, "fold_scored", None)
    got = pipe.out_of_fold(rows, "y", "fold", 3, "p")
    assert got.columns == [*rows.columns, "p_0", "p_1", "p_2"]
    got = got.orderBy("id").toPandas()
    assert np.allclose(got[["p_0", "p_1", "p_2"]].sum(axis=1), 1) and len(got) == 401
    flipped = rows.withColumn("y", F.when(F.col("fold") == 1, 2).otherwise(F.col("y")))
    again = pipe.out_of_fold(flipped, "y", "fold", 3, "p").orderBy("id").toPandas()
    same = np.isclose(got["p_0"], again["p_0"], atol=1e-9)
    assert same[got.fold == 1].all() and not same.all()  # own labels never move an own row


@pytest.mark.parametrize("cells", [1 << 23, 1 << 8])
def test_quantiles_outside_each_fold_are_exact(spark, monkeypatch, cells):
    from tabstrata.operators import quantiles as QU

    monkeypatch.setattr(QU, "PASS_CELLS", cells)  # few cells: fewer bits to a pass
    rng = np.random.default_rng(8)
    odd = [0.0, -0.0, 1e-300, -1e300, 5e-324, -5e-324, 7.0, 7.0, 7.0]
    data = [(float(a), float(int(b)), i % 3, None) for i, (a, b) in enumerate(rng.normal(size=(500, 2)) * [1e-3, 4])]
    data += [(x, None, i % 3, None) for i, x in enumerate(odd)]
    df = spark.createDataFrame(data, "x double, n double, fold int, none double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = QU.fold_quantiles(df, ["x", "n", "none"], probs, "fold", 3)
    for j in range(4):
        want = QU.quantiles(df.where(F.col("fold") != j), ["x", "n"], probs)[()]
        assert got[j] == want | {"none": None}


def test_scaled_columns_are_read_once_for_all_models(rows, monkeypatch):
    from tabstrata.learners import perceptron as PE
    from tabstrata.learners.base import rows_of

    ready, names = FP.scaled(rows, ["a"], ["b"], "fold", 3)
    learner, blocks, real = PE.Perceptron(3, (4,), max_iter=5), [], PE.partial_sums

    def seen(frame, *args):
        blocks.extend(b for batch in frame.toArrow().to_batches() for b in rows_of(batch))
        return real(frame, *args)

    monkeypatch.setattr(PE, "partial_sums", seen)
    got = learner.fit_folds(ready, names, "y", "fold", 3)
    assert {b.num_columns for b in blocks} == {2 + 3}  # eight scaled columns have two sources
    want = learner.fit_folds(ready.select("*"), [[str.__str__(n) for n in part] for part in names], "y", "fold", 3)
    assert {b.num_columns for b in blocks} == {2 + 3, 8 + 3}
    for g, w in zip(got, want):
        assert np.array_equal(g.flat, w.flat)


def test_compact_numbers_keep_their_bits():
    from tabstrata.learners.base import compact, numbers

    for x in (np.random.default_rng(1).normal(size=1000), np.arange(1000.0) % 9, np.array([np.nan, 1.0, np.nan, -np.inf])):
        assert np.array_equal(numbers(compact(x)), x, equal_nan=True)
    assert compact(np.arange(1000.0) % 9).nbytes < 2000
