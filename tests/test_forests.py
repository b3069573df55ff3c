"""Forests on shared histograms against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.learners import forests as FO
from tabstrata.learners.base import score
from tabstrata.learners.boosting import Binner

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1200, 3)), 2)
    y = (x[:, 1] + 0.3 * rng.normal(size=1200) > 0.4).astype(int) + (x[:, 0] > 1.0)
    data = [(i, *map(float, r), int(c), i % 3) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, y int, fold int").repartition(4).persist()
    return df, x, y


def gini(y, w=None):
    n = np.bincount(y, w, minlength=3)
    return n.sum() - (n**2).sum() / max(n.sum(), 1e-12)


def test_first_split_tries_every_cut(rows):
    df, x, y = rows
    forest = FO.RandomForest(3, 1, 1, 5, None, bootstrap=False)
    model = forest.fit(df, COLUMNS, "y")
    binner = Binner(COLUMNS, [], 64).fit(df)
    best = max(
        (round(gini(y) - gini(y[x[:, f] <= c]) - gini(y[x[:, f] > c]), 6), -f, -b)
        for f in range(3)
        for b, c in enumerate(binner.cuts[COLUMNS[f]])
        if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) >= 5
    )
    (tree,) = model.trees
    assert (tree.feature[0], tree.cut[0]) == (-best[1], -best[2])
    left = x[:, tree.feature[0]] <= binner.cuts[COLUMNS[tree.feature[0]]][tree.cut[0]]
    assert np.allclose(tree.value[1], np.bincount(y[left], minlength=3) / left.sum())


def test_first_split_of_extra_trees_is_the_best_of_the_drawn_cuts(rows):
    df, x, y = rows
    weights = len(y) / (3 * np.bincount(y))
    for seed in range(4):
        model = FO.ExtraTrees(3, 1, 1, 5, None, seed=seed).fit(df, COLUMNS, "y")
        binner = Binner(COLUMNS, [], 256).fit(df)
        found = []
        for f in range(3):
            edges = binner.cuts[COLUMNS[f]]
            bins = np.searchsorted(edges, x[:, f], side="left")
            some = edges[bins.min() : bins.max()]
            u = FO.draw(seed + 1, 0, 0, np.arange(3))[f]
            drawn = some[0] + u * (some[-1] - some[0])
            cut = some[some <= drawn][-1]
            left = x[:, f] <= cut
            w = weights[y]
            found.append((gini(y, w) - gini(y[left], w[left]) - gini(y[~left], w[~left]), -f, cut))
        gain, f, cut = max(found)
        (tree,) = model.trees
        assert tree.feature[0] == -f and binner.cuts[COLUMNS[-f]][tree.cut[0]] == cut


@pytest.mark.parametrize("kind", [FO.RandomForest, FO.ExtraTrees])
def test_same_forest_after_repartitioning_and_limits(rows, kind):
    df, x, y = rows
    params = dict(n_estimators=4, max_depth=6, min_samples_leaf=9, min_samples_split=120, max_features=0.7)
    a = kind(3, **params).fit(df, COLUMNS, "y")
    b = kind(3, **params).fit(df.repartition(1), COLUMNS, "y")
    for s, t in zip(a.trees, b.trees):
        assert all(np.array_equal(getattr(s, name), getattr(t, name)) for name in ("feature", "cut", "child", "value"))
    assert sum((t.feature >= 0).sum() for t in a.trees) > 8
    bins = a.binner.pack(*x.T)
    h = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()]).view(np.uint64)
    for t, tree in enumerate(a.trees):
        w = np.searchsorted(FO.POISSON, FO._mix(h, 42 * 31 + 7 * t + 1)) if kind is FO.RandomForest else np.ones(len(x))
        inside = {0: np.arange(len(x))[w > 0]}
        for n in range(len(tree.feature)):
            rows = inside[n]
            assert len(rows) >= 9
            if tree.feature[n] >= 0:
                assert len(rows) >= 120
                right = bins[rows, tree.feature[n]] > tree.cut[n]
                inside[tree.child[n]], inside[tree.child[n] + 1] = rows[~right], rows[right]
            if kind is FO.RandomForest:
                counts = np.bincount(y[rows], w[rows], minlength=3)
                assert np.allclose(tree.value[n], counts / counts.sum())


def test_own_fold_never_trains_and_loss_beats_the_prior(rows):
    df, x, y = rows
    forest = FO.RandomForest(3, 6, 5, 5, class_weight="balanced_subsample", criterion="entropy")
    models = forest.fit_folds(df, COLUMNS, "y", "fold", 3)
    flipped = df.withColumn("y", F.when(F.col("fold") == 1, 0).otherwise(F.col("y")))
    other = forest.fit_folds(flipped, COLUMNS, "y", "fold", 3)
    same = [all(np.array_equal(s.value, t.value) for s, t in zip(m.trees, o.trees)) for m, o in zip(models, other)]
    assert same == [False, True, False, False]
    got = score(df, models, "p", "fold").orderBy("id").toPandas()
    p = got[["p_0", "p_1", "p_2"]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.8
    assert np.allclose(p[got.fold == 2], models[2].predict_array(x[got.fold == 2]))


def test_two_hundred_trees_plan_and_score(rows):
    df, x, _ = rows
    model = FO.ExtraTrees(3, 200, 3, 20).fit(df, COLUMNS, "y")
    assert len(model.trees) == 200
    assert model.score(df, "p").agg(F.sum("p_0") + F.sum("p_1") + F.sum("p_2")).first()[0] == pytest.approx(1200)


def test_feature_lists_by_model_constant_columns_and_ties(spark, rows):
    df, x, y = rows
    wide = df.withColumn("k", F.lit(1.0))
    sets = [["a", "k"], ["b", "k"], ["c", "k"], ["k", "a"]]
    models = FO.RandomForest(3, 2, 3, 5, 0.5).fit_folds(wide, sets, "y", "fold", 3)
    assert [m.features for m in models] == sets
    for m, s in zip(models, "abca"):
        used = np.concatenate([t.feature[t.feature >= 0] for t in m.trees])
        assert len(used) and (used == m.features.index(s)).all()
    flat = FO.RandomForest(3, 2, 3).fit(wide, ["k"], "y")
    assert all((t.feature == -1).all() for t in flat.trees)
    same = df.select("y", *[F.lit(0.5).alias(c) for c in COLUMNS])  # no key, equal rows
    assert FO.RandomForest(3, 2, 3).fit(same, COLUMNS, "y").score(same, "p").count() == 1200


def test_poisson_draws():
    n = np.searchsorted(FO.POISSON, FO._mix(np.arange(200_000, dtype=np.uint64), 5))
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03
    u = np.array([FO.draw(1, t, n, np.arange(5)) for t in range(40) for n in range(40)])
    assert abs(u.mean() - 0.5) < 0.02 and len(np.unique(u)) == u.size
