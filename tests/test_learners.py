"""Learner properties: closed forms against numpy, loss falls with rounds, nothing leaks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.learners import boosting as BO
from tabstrata.learners.base import score
from tabstrata.learners.calibrated import Calibrated
from tabstrata.learners.linear import AveragedSGD, ElasticNetLogistic, SquaredHingeSVC
from tabstrata.learners.forests import ExtraTrees, RandomForest
from tabstrata.learners.mllib import SparkLogistic
from tabstrata.learners.moments import MomentLearner
from tabstrata.operators import encode as EN
from tabstrata.operators import metrics as ME
from tabstrata.operators import scale as SC
from tabstrata.operators.class_weights import axis_grid, fit_class_weights, log_grid
from tabstrata.plans.pipeline import Pipeline
from tabstrata.sources import artifacts
from tabstrata.sources.tables import CATEGORIES, NUMERIC

P3 = ["p_0", "p_1", "p_2"]
UNIFORM = np.log(3)


def loss_of(scored):
    return ME.log_loss(scored, "class_encoded", P3).first()[0]


def arrays(df, features=NUMERIC):
    pdf = df.select("id", "fold", "class_encoded", *features).toPandas().sort_values("id")
    return pdf["id"].to_numpy(), pdf["fold"].to_numpy(), pdf["class_encoded"].to_numpy(), pdf[features].to_numpy()


def check_rows(scored):
    bad = scored.where(
        (F.abs(F.col("p_0") + F.col("p_1") + F.col("p_2") - 1) > 1e-9) | F.least(*P3).isNull() | (F.least(*P3) < 0)
    )
    assert bad.count() == 0


# closed forms ---------------------------------------------------------------------------------------
def numpy_lda(x, y):
    mu = np.stack([x[y == c].mean(axis=0) for c in range(3)])
    n = np.array([(y == c).sum() for c in range(3)])
    sw = sum((x[y == c] - mu[c]).T @ (x[y == c] - mu[c]) for c in range(3)) / (len(y) - 3)
    coef = mu @ np.linalg.pinv(sw)
    return coef, -0.5 * (coef * mu).sum(axis=1) + np.log(n / n.sum())


@pytest.mark.parametrize("features", [NUMERIC, [*NUMERIC, "extra"]], ids=["expressions", "partial sums"])
def test_lda_folds_equal_numpy(train, features):
    df = train.withColumn("extra", F.col("u") * F.col("z") - F.col("g"))
    models = MomentLearner("lda", 3).fit_folds(df, features, "class_encoded", "fold", 5)
    _, fold, y, x = arrays(df, features)
    for j in (0, 3, 5):
        coef, b = numpy_lda(x[fold != j], y[fold != j])
        assert models[j].coef == pytest.approx(coef, rel=1e-6, abs=1e-6)
        assert models[j].intercept == pytest.approx(b, rel=1e-6, abs=1e-6)


def test_qda_equals_numpy(train):
    model = MomentLearner("qda", 3, reg_param=0.2).fit(train, NUMERIC, "class_encoded")
    _, _, y, x = arrays(train)
    m = []
    for c in range(3):
        xc = x[y == c]
        cov = 0.8 * np.cov(xc.T) + 0.2 * np.eye(len(NUMERIC))
        z = x - xc.mean(axis=0)
        m.append(np.log(len(xc) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (z @ np.linalg.inv(cov) * z).sum(axis=1))
    m = np.stack(m, axis=1)
    want = np.exp(m - m.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    got = model.score(train, "p").orderBy("id").select(*P3).toPandas().to_numpy()
    assert got == pytest.approx(want, abs=1e-8)


def test_ridge_equals_numpy(train):
    model = MomentLearner("ridge", 3, alpha=3.0).fit(train, NUMERIC, "class_encoded")
    _, _, y, x = arrays(train)
    w = np.array([len(y) / (3 * (y == c).sum()) for c in range(3)])[y]
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    for c in range(3):
        t = np.where(y == c, 1.0, -1.0)
        tm = (w * t).sum() / w.sum()
        xc = x - mean
        coef = np.linalg.solve((w[:, None] * xc).T @ xc + 3.0 * np.eye(x.shape[1]), (w[:, None] * xc).T @ (t - tm))
        assert model.coef[c] == pytest.approx(coef, rel=1e-8, abs=1e-10)
        assert model.intercept[c] == pytest.approx(tm - coef @ mean, rel=1e-8, abs=1e-10)


def test_column_and_array_scoring_agree(train):
    model = MomentLearner("lda", 3).fit(train, ["u", "z"], "class_encoded")
    got = model.score(train, "p").orderBy("id").select(*P3).toPandas().to_numpy()
    assert got == pytest.approx(model.predict_array(arrays(train, ["u", "z"])[3]), abs=1e-12)


def test_truncated_svd_equals_numpy(train):
    svd = SC.TruncatedSVD(NUMERIC, 3).fit(train)
    _, _, _, x = arrays(train)
    _, s, _ = np.linalg.svd(x, full_matrices=False)
    assert svd.singular_values_ == pytest.approx(s[:3], rel=1e-9)
    out = svd.transform(train).select(*svd.names).toPandas().to_numpy()
    assert np.linalg.norm(out, axis=0) == pytest.approx(s[:3], rel=1e-9)


# linear ---------------------------------------------------------------------------------------------
def test_squared_hinge_reaches_its_optimum(train):
    fit = SquaredHingeSVC(3, C=0.05, tol=1e-7, max_iter=60, class_weight=None).fit(train, NUMERIC, "class_encoded")
    _, _, y, x = arrays(train)
    a = np.column_stack([x, np.ones(len(x))])
    for c in range(3):
        t = np.where(y == c, 1.0, -1.0)
        w = np.append(fit.coef[c], fit.intercept[c])
        grad = w - 2 * 0.05 * (a * (t * np.maximum(0, 1 - t * (a @ w)))[:, None]).sum(axis=0)
        start = 2 * 0.05 * (a * t[:, None]).sum(axis=0)
        assert np.abs(grad).max() < 0.005 * np.abs(start).max()


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_svc_reaches_the_minimum_with_every_solver(train, monkeypatch, penalty):
    """Optimality conditions of all models of a cross-validation; first-order steps end at the same coefficients."""
    C, k_folds = 0.01, 5
    svc = SquaredHingeSVC(3, penalty, C=C, tol=1e-9, max_iter=60, class_weight=None)
    models = svc.fit_folds(train, NUMERIC, "class_encoded", "fold", k_folds)
    _, fold, y, x = arrays(train)
    a = np.column_stack([x, np.ones(len(x))])
    for j, m in enumerate(models):
        use = fold != j if j < k_folds else np.ones(len(y), dtype=bool)
        for c in range(3):
            t = np.where(y[use] == c, 1.0, -1.0)
            w = np.append(m.coef[c], m.intercept[c])
            slope = -2 * C * (a[use] * (t * np.maximum(0, 1 - t * (a[use] @ w)))[:, None]).sum(axis=0)
            if penalty == "l2":
                assert np.abs(slope + w).max() < 1e-6
            else:
                zero = w == 0
                assert np.abs(slope + np.sign(w))[~zero].max(initial=0.0) < 1e-6 and (np.abs(slope)[zero] <= 1 + 1e-6).all()
    monkeypatch.setattr(SquaredHingeSVC, "WIDE", 0)
    slow = SquaredHingeSVC(3, penalty, C=0.001, tol=1e-6, max_iter=60, class_weight=None).fit(train, NUMERIC, "class_encoded")
    monkeypatch.setattr(SquaredHingeSVC, "WIDE", 200)
    fast = SquaredHingeSVC(3, penalty, C=0.001, tol=1e-9, class_weight=None).fit(train, NUMERIC, "class_encoded")
    assert np.abs(slow.coef - fast.coef).max() < 0.02 * np.abs(fast.coef).max()


def test_l1_penalty_zeroes_coefficients(train):
    fit = SquaredHingeSVC(3, "l1", C=0.002, max_iter=30).fit(train, NUMERIC, "class_encoded")
    assert (fit.coef == 0).mean() > 0.3


@pytest.mark.parametrize("loss,rate", [("log_loss", "optimal"), ("hinge", "invscaling"), ("modified_huber", "adaptive"), ("perceptron", "constant")])
def test_sgd_learns(train, loss, rate):
    sgd = AveragedSGD(3, loss=loss, learning_rate=rate, eta0=0.2, alpha=1e-3, average=True, max_iter=8)
    scored = sgd.fit(train, NUMERIC, "class_encoded").score(train, "p")
    check_rows(scored)
    hit = scored.select(F.avg((F.expr("array_position(array(p_0,p_1,p_2), greatest(p_0,p_1,p_2)) - 1") == F.col("class_encoded")).cast("int"))).first()[0]
    assert hit > (0.45 if loss == "hinge" else 0.55)  # hinge cannot single out the middle class


@pytest.mark.parametrize("l1_ratio", [0.0, 0.6])
def test_elastic_net_optimality(train, l1_ratio):
    model = ElasticNetLogistic(3, C=0.1, l1_ratio=l1_ratio, tol=1e-10, max_iter=40).fit(train, NUMERIC, "class_encoded")
    _, _, y, x = arrays(train)
    grad = (model.predict_array(x) - np.eye(3)[y]).T @ x + (1 - l1_ratio) * model.coef / 0.1
    zero = np.abs(model.coef) < 1e-9
    bound = l1_ratio / 0.1
    assert np.abs(grad + bound * np.sign(model.coef))[~zero].max() < 1e-3
    assert (np.abs(grad)[zero] <= bound + 1e-3).all()


def test_elastic_net_folds_equal_spark(train):
    kw = dict(C=0.5, l1_ratio=0.3, class_weight="balanced", tol=1e-9, max_iter=200)
    ours = ElasticNetLogistic(3, **kw).fit_folds(train, NUMERIC, "class_encoded", "fold", 5)
    part = train.where("fold <> 2")
    theirs = SparkLogistic(3, **kw).fit(part, NUMERIC, "class_encoded")
    _, _, _, x = arrays(part)
    assert ours[2].predict_array(x) == pytest.approx(theirs.predict_array(x), abs=2e-3)


def test_wide_logistic_falls_back(train, monkeypatch):
    monkeypatch.setattr(ElasticNetLogistic, "WIDE", 5)
    models = ElasticNetLogistic(3, max_iter=5).fit_folds(train, ["u", "z"], "class_encoded", "fold", 2)
    assert len(models) == 3 and models[0].coef.shape == (3, 2)


# boosting -------------------------------------------------------------------------------------------
SPEC = replace(BO.DEPTHWISE, rounds=3, max_depth=3, learning_rate=0.4, max_bins=32, checkpoint_every=2)


@pytest.mark.parametrize(
    "spec",
    [
        SPEC,
        replace(BO.LEAFWISE, rounds=3, max_depth=4, max_leaves=6, learning_rate=0.4, max_bins=32, subsample=0.7, subsample_every=2),
        replace(BO.SYMMETRIC, rounds=3, max_depth=3, learning_rate=0.4, max_bins=32, early_stopping=2, class_weight="max_ratio"),
        replace(BO.HISTOGRAM, rounds=3, max_depth=3, learning_rate=0.4, max_bins=32, early_stopping=2),
    ],
    ids=["depth", "leaf", "symmetric", "histogram"],
)
def test_boosting_presets_learn(train, spec):
    scored = BO.HistogramBooster(3, spec, NUMERIC, CATEGORIES).fit(train, "class_encoded").score(train, "p")
    check_rows(scored)
    assert loss_of(scored) < 0.9 < UNIFORM
    assert scored.count() == train.count()


def test_boosting_loss_falls_and_leaf_cap_holds(train):
    model = BO.HistogramBooster(3, replace(SPEC, rounds=4, max_leaves=4), NUMERIC, []).fit(train, "class_encoded")
    losses = []
    for r in (1, 2, 4):
        part = BO.BoostedModel(model.binner, 3, model.base, model.trees[:r])
        losses.append(loss_of(part.score(train, "p")))
    assert losses[0] > losses[1] > losses[2]
    assert all((t.feature >= 0).sum() <= 3 for per in model.trees for t in per)


def test_boosting_first_split_equals_brute_force(train):
    spec = replace(SPEC, rounds=1, max_depth=1, reg_lambda=0.5)
    model = BO.HistogramBooster(3, spec, NUMERIC, []).fit(train, "class_encoded")
    _, _, y, x = arrays(train)
    bins = model.binner.pack(*x.T)
    prior = np.bincount(y) / len(y)
    for c in range(3):
        g = prior[c] - (y == c)
        h = np.full(len(y), 2 * prior[c] * (1 - prior[c]))
        best = (-1.0, None)
        for f in range(len(NUMERIC)):
            for b in range(31):
                left = bins[:, f] <= b
                if left.all() or not left.any():
                    continue
                parts = [g[s].sum() ** 2 / (h[s].sum() + 0.5) for s in (left, ~left)]
                gain = 0.5 * (sum(parts) - g.sum() ** 2 / (h.sum() + 0.5))
                if gain > best[0] + 1e-9:
                    best = (gain, (f, left))
        f, left = best[1]
        tree = model.trees[0][c]
        assert tree.feature[0] == f
        assert (tree.goes_left(np.zeros(len(bins), dtype=int), bins[:, f]) == left).all()
        want = -0.4 * g[left].sum() / (h[left].sum() + 0.5)
        assert tree.value[1] == pytest.approx(want, rel=1e-9)


def test_boosting_same_after_repartition_and_in_groups(train, monkeypatch):
    learner = BO.HistogramBooster(3, SPEC, NUMERIC, CATEGORIES)
    keep = train.select("id", *NUMERIC, *CATEGORIES, "class_encoded", "fold")
    a = score(keep, learner.fit_folds(keep, "class_encoded", "fold", 5), "p", "fold")
    monkeypatch.setattr(BO, "HISTOGRAM_CELLS", 30_000)  # a few trees at a time
    monkeypatch.setattr(BO, "TASK_CELLS", 5_000)  # a few nodes per job
    other = keep.repartition(5, "u")
    b = score(other, learner.fit_folds(other, "class_encoded", "fold", 5), "q", "fold")
    gap = a.join(b.select("id", "q_0", "q_1", "q_2"), "id")
    assert gap.select(F.max(F.abs(F.col("p_0") - F.col("q_0")))).first()[0] < 1e-6


# leakage --------------------------------------------------------------------------------------------
def flipped(df, key):
    """The same table with one row's label changed; folds stay as they were."""
    return df.withColumn(
        "class_encoded", F.when(F.col("id") == key, (F.col("class_encoded") + 1) % 3).otherwise(F.col("class_encoded"))
    )


@pytest.mark.parametrize("kind", ["lda", "boost", "compose"])
def test_own_label_never_moves_own_oof_row(train, kind):
    keep = train.select("id", *NUMERIC, *CATEGORIES, "class_encoded", "fold").persist()
    if kind == "boost":
        pipe = Pipeline(BO.HistogramBooster(3, replace(SPEC, rounds=2), NUMERIC, CATEGORIES), NUMERIC)
    elif kind == "lda":
        pipe = Pipeline(MomentLearner("lda", 3), NUMERIC)
    else:
        pipe = Pipeline(MomentLearner("lda", 3), NUMERIC, CATEGORIES, "compose")
    row = keep.orderBy("id").first()
    key, fold = row["id"], row["fold"]
    out = []
    for df in (keep, flipped(keep, key)):
        part = pipe.fold_scored(df, "class_encoded", "fold", fold, "p") if kind == "compose" else pipe.out_of_fold(
            df, "class_encoded", "fold", 5, "p"
        )
        out.append(part.where(F.col("id") == key).select(*P3).first())
    assert list(out[0]) == pytest.approx(list(out[1]), abs=1e-12)


def test_target_encoding_ignores_own_label(train):
    keep = train.select("id", *CATEGORIES, "class_encoded", "fold").persist()
    key = keep.orderBy("id").first()["id"]
    got = []
    for df in (keep, flipped(keep, key)):
        enc = EN.TargetEncoder(CATEGORIES, 3, "auto")
        got.append(enc.fit_transform(df, "class_encoded", "fold", 5).where(F.col("id") == key).select(*enc.names()).first())
    assert list(got[0]) == pytest.approx(list(got[1]), abs=1e-15)


def test_unseen_and_null_categories_get_the_prior(spark):
    rows = [("a", 0), ("a", 1), ("b", 1), ("b", 1), (None, 0)]
    df = spark.createDataFrame(rows, "c string, y int")
    enc = EN.TargetEncoder(["c"], 2, 1.0).fit(df, "y")
    new = spark.createDataFrame([("zzz",), (None,), ("b",)], "c string")
    got = {r["c"]: (r["c_te_0"], r["c_te_1"]) for r in enc.transform(new).collect()}
    assert got["zzz"] == pytest.approx((0.4, 0.6))
    assert got[None] == pytest.approx(((1 + 0.4) / 2, 0.6 / 2))
    assert got["b"] == pytest.approx((0.4 / 3, (2 + 0.6) / 3))
    mean = EN.MeanTargetEncoder(["c"], 1.0).fit(df, "y").transform(new).collect()
    assert {r["c"]: r["c_mean"] for r in mean}["zzz"] == pytest.approx(0.6)
    codes = EN.CategoryCodes.fit(df, "c").encode(new, "k").collect()
    assert {r["c"]: r["k"] for r in codes} == {"zzz": 2, None: 2, "b": 1}


# forests, calibration, artifacts ----------------------------------------------------------------------
def test_artifacts_keep_scores(spark, train, tmp_path):
    calibrated = Calibrated(MomentLearner("ridge", 3), 3).fit(train, NUMERIC, "class_encoded")
    boosted = BO.HistogramBooster(3, replace(SPEC, rounds=2), NUMERIC, CATEGORIES).fit(train, "class_encoded")
    forest = RandomForest(3, 3, 4).fit(train, NUMERIC, "class_encoded")
    extra = ExtraTrees(3, 2, 5).fit(train, NUMERIC, "class_encoded")
    for i, model in enumerate((calibrated, boosted, forest, extra)):
        path = str(tmp_path / f"m{i}")
        assert not artifacts.exists(spark, path)
        again = artifacts.load_model(spark, artifacts.save_model(spark, model, path))
        assert artifacts.exists(spark, path)
        both = again.score(model.score(train, "p"), "q")
        check_rows(both)
        assert both.select(F.max(F.abs(F.col("p_1") - F.col("q_1")))).first()[0] < 1e-9
        assert loss_of(both) < 1.0
    labels = artifacts.load_model(spark, artifacts.save_model(spark, EN.LabelCodes(["A", "B"]), str(tmp_path / "l")))
    assert labels.classes == ["A", "B"]


# class weights ----------------------------------------------------------------------------------------
def test_class_weights_beat_plain_argmax(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        y = int(rng.choice(3, p=[0.8, 0.15, 0.05]))
        p = np.array([0.7, 0.2, 0.1]) + 0.2 * np.eye(3)[y] + rng.random(3) * 0.1
        rows.append((i, y, *(p / p.sum()).tolist()))
    df = spark.createDataFrame(rows, "id long, y int, p_0 double, p_1 double, p_2 double")
    for kw in ({"k_folds": 3}, {"k_folds": 1}, {"k_folds": 3, "mode": "valid"}):
        fit = fit_class_weights(df, "y", P3, refinements=1, **kw)
        assert all(w > 0 for w in fit.weights)
        got = ME.balanced_accuracy(ME.confusion(df, "y", fit.predict(P3))).first()[0]
        assert got > 0.95


def test_log_grid_sizes():
    assert len(log_grid(3)) == 81 and log_grid(3)[40] == [1.0, 1.0, 1.0]
    assert len(log_grid(5)) == 9**4 and len(axis_grid(8)) == 1 + 7 * 8
