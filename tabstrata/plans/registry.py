"""Learners by name with their search spaces, and which of them each layer trains.

The ranges and constants below are fixed values of the workload this library reproduces; the size
of a model (rounds, trees, iterations) is an argument, so that tests can cap it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from tabstrata.learners import boosting as BO
from tabstrata.learners.calibrated import Calibrated
from tabstrata.learners.knn import SvdKnn
from tabstrata.learners.linear import AveragedSGD, ElasticNetLogistic, SquaredHingeSVC
from tabstrata.learners.forests import ExtraTrees, RandomForest
from tabstrata.learners.moments import MomentLearner
from tabstrata.learners.perceptron import Perceptron
from tabstrata.plans.pipeline import Pipeline
from tabstrata.plans.space import Param, choice, integer, log_uniform, uniform


@dataclass(frozen=True)
class LearnerSpec:
    """``build(params, k, numeric, categories, cap)``; categories are empty in stacking layers."""

    name: str
    space: tuple[Param, ...]
    build: Callable[..., Pipeline]
    warmup: int = 2
    stacking_space: tuple[Param, ...] | None = None
    n_jobs: int = 4

    def space_for(self, stacking: bool) -> tuple[Param, ...]:
        return self.stacking_space if stacking and self.stacking_space else self.space


def _boosted(spec, k, numeric, categories, cap):
    rounds = min(spec.rounds, cap) if cap else spec.rounds
    return Pipeline(BO.HistogramBooster(k, replace(spec, rounds=rounds), numeric, categories), numeric, categories)


def _xgboost(p, k, numeric, categories, cap=None):
    spec = replace(
        BO.DEPTHWISE,
        max_depth=p["max_depth"],
        learning_rate=p["learning_rate"],
        rounds=p["n_estimators"],
        subsample=p["subsample"],
        colsample=p["colsample_bytree"],
        gamma=p["gamma"],
        reg_alpha=p["reg_alpha"],
        reg_lambda=p["reg_lambda"],
        min_child_weight=1.0,
        max_bins=256,
    )
    return _boosted(spec, k, numeric, categories, cap)


def _lightgbm(p, k, numeric, categories, cap=None):
    spec = replace(
        BO.LEAFWISE,
        rounds=2000,
        max_leaves=p["num_leaves"],
        max_depth=p["max_depth"],
        learning_rate=p["learning_rate"],
        reg_alpha=p["lambda_l1"],
        reg_lambda=p["lambda_l2"],
        colsample=p["feature_fraction"],
        subsample=p["bagging_fraction"],
        subsample_every=p["bagging_freq"],
        min_child_rows=float(p["min_child_samples"]),
        max_bins=255,
    )
    return _boosted(spec, k, numeric, categories, cap)


def _catboost(p, k, numeric, categories, cap=None):
    modes = {None: None, "Balanced": "max_ratio", "SqrtBalanced": "sqrt_ratio"}
    spec = replace(
        BO.SYMMETRIC,
        rounds=1500 if categories else 3000,
        early_stopping=100 if categories else 150,
        class_weight=modes[p["auto_class_weights"]],
        max_depth=p["depth"],
        min_child_rows=float(p["min_data_in_leaf"]),
        learning_rate=p["learning_rate"],
        reg_lambda=p["l2_leaf_reg"],
        bagging_temperature=p["bagging_temperature"],
        colsample=p["rsm"],
        max_bins=254,
    )
    return _boosted(spec, k, numeric, categories, cap)


def _hist(p, k, numeric, categories, cap=None):
    spec = replace(
        BO.HISTOGRAM,
        rounds=1000,
        learning_rate=p["learning_rate"],
        max_depth=p["max_depth"],
        min_child_rows=float(p["min_samples_leaf"]),
        reg_lambda=p["l2_regularization"],
        max_bins=p["max_bins"],
    )
    return _boosted(spec, k, numeric, categories, cap)


def _prep(categories, kind):
    return kind if categories else None


def _extra_trees(p, k, numeric, categories, cap=None):
    n = min(p["n_estimators"], cap) if cap else p["n_estimators"]
    learner = ExtraTrees(k, **{**p, "n_estimators": n})
    return Pipeline(learner, numeric, categories, _prep(categories, "mean"))


def _random_forest(p, k, numeric, categories, cap=None):
    n = min(p["n_estimators"], cap) if cap else p["n_estimators"]
    learner = RandomForest(k, **{**p, "n_estimators": n})
    return Pipeline(learner, numeric, categories, _prep(categories, "mean"))


def _logistic(p, k, numeric, categories, cap=None):
    p = {"class_weight": "balanced", "max_iter": 1000, **p} if categories else dict(p)
    if cap:
        p["max_iter"] = min(p["max_iter"], cap)
    return Pipeline(ElasticNetLogistic(k, **p), numeric, categories, _prep(categories, "compose"))


def _ridge(p, k, numeric, categories, cap=None):
    base = MomentLearner("ridge", k, alpha=p["alpha"], fit_intercept=p["fit_intercept"])
    return Pipeline(Calibrated(base, 5), numeric, categories, _prep(categories, "compose"))


def _sgd(p, k, numeric, categories, cap=None):
    p = {"max_iter": 5000, "class_weight": "balanced", **p}
    if cap:
        p["max_iter"] = min(p["max_iter"], cap)
    return Pipeline(AveragedSGD(k, **p), numeric, categories, _prep(categories, "compose"))


def _linear_svc(p, k, numeric, categories, cap=None):
    base = SquaredHingeSVC(k, p["penalty"], p["C"], p["tol"], cap or 5000)
    return Pipeline(Calibrated(base, 5), numeric, categories, _prep(categories, "compose"))


def _mlp(p, k, numeric, categories, cap=None):
    hidden = tuple(p[f"hidden_{i}"] for i in range(p["n_layers"]))
    # batch_size is part of the space but has no counterpart: every step sees all rows
    learner = Perceptron(k, hidden, p["activation"], p["alpha"], p["learning_rate_init"], p["tol"], cap or 1000)
    return Pipeline(learner, numeric, categories, _prep(categories, "compose"))


def _lda(p, k, numeric, categories, cap=None):
    learner = MomentLearner(
        "lda", k, solver=p["solver"], shrinkage=p.get("shrinkage"), tol=p.get("tol", 1e-4)
    )
    return Pipeline(learner, numeric, categories, _prep(categories, "compose"))


def _qda(p, k, numeric, categories, cap=None):
    learner = MomentLearner("qda", k, reg_param=p["reg_param"], tol=p["tol"])
    return Pipeline(learner, numeric, categories, _prep(categories, "compose"))


def _svd_knn(p, k, numeric, categories, cap=None):
    learner = SvdKnn(k, p["n_components"], p["n_neighbors"], p["weights"], p["p"], p["metric"])
    return Pipeline(learner, numeric, categories, _prep(categories, "compose"))


_XGB = (
    integer("max_depth", 3, 10),
    log_uniform("learning_rate", 1e-3, 0.1),
    integer("n_estimators", 100, 1500),
    uniform("subsample", 0.5, 1.0),
    uniform("colsample_bytree", 0.5, 1.0),
    uniform("gamma", 0.0, 5.0),
    log_uniform("reg_alpha", 1e-8, 10.0),
    log_uniform("reg_lambda", 1e-8, 10.0),
)
_LGBM = (
    integer("num_leaves", 16, 256),
    integer("max_depth", 3, 12),
    log_uniform("learning_rate", 0.01, 0.2),
    log_uniform("lambda_l1", 1e-3, 10.0),
    log_uniform("lambda_l2", 1e-3, 10.0),
    uniform("feature_fraction", 0.6, 1.0),
    uniform("bagging_fraction", 0.6, 1.0),
    integer("bagging_freq", 1, 7),
    integer("min_child_samples", 10, 100),
)
_CAT = (
    choice("auto_class_weights", None, "Balanced", "SqrtBalanced"),
    integer("depth", 4, 10),
    integer("min_data_in_leaf", 1, 100),
    log_uniform("learning_rate", 1e-3, 0.2),
    log_uniform("l2_leaf_reg", 1e-3, 20.0),
    uniform("bagging_temperature", 0.0, 10.0),
    uniform("rsm", 0.5, 1.0),
)
_HIST = (
    log_uniform("learning_rate", 0.01, 0.3),
    integer("max_depth", 3, 10),
    integer("min_samples_leaf", 20, 100),
    uniform("l2_regularization", 0.0, 10.0),
    integer("max_bins", 64, 255),
)
_ET = (
    integer("n_estimators", 100, 500),
    integer("max_depth", 5, 15),
    integer("min_samples_leaf", 20, 150),
    uniform("max_features", 0.1, 0.4),
    choice("criterion", "gini", "entropy"),
)
_RF = (
    integer("n_estimators", 100, 1000),
    integer("max_depth", 8, 20),
    integer("min_samples_split", 2, 20),
    integer("min_samples_leaf", 20, 50),
    choice("max_features", "sqrt", "log2"),
    choice("criterion", "gini", "entropy", "log_loss"),
    choice("bootstrap", True, False),
    choice("class_weight", None, "balanced", "balanced_subsample"),
)
_LOGISTIC = (log_uniform("C", 1e-5, 100.0), uniform("l1_ratio", 0.0, 1.0))
_LOGISTIC_STACK = _LOGISTIC + (
    choice("class_weight", None, "balanced"),
    choice("fit_intercept", True, False),
    log_uniform("tol", 1e-6, 1e-2),
    integer("max_iter", 1000, 5000),
)
_SGD = (
    choice("loss", "log_loss", "modified_huber"),
    choice("penalty", "l2", "l1", "elasticnet"),
    log_uniform("alpha", 1e-7, 0.1),
    choice("learning_rate", "optimal", "adaptive"),
    log_uniform("eta0", 1e-4, 0.1),
    uniform("l1_ratio", 0.0, 1.0),
    log_uniform("tol", 1e-5, 1e-2),
    choice("average", True, False),
)
_SGD_STACK = (
    choice("loss", "log_loss", "modified_huber", "hinge", "perceptron"),
    choice("penalty", "l2", "l1", "elasticnet"),
    log_uniform("alpha", 1e-9, 0.1),
    uniform("l1_ratio", 0.0, 1.0),
    choice("learning_rate", "optimal", "adaptive", "constant", "invscaling"),
    log_uniform("eta0", 1e-5, 1.0),
    uniform("power_t", 0.1, 0.5, when=("learning_rate", ("invscaling",))),
    log_uniform("epsilon", 1e-3, 0.1, when=("loss", ("modified_huber",))),
    log_uniform("tol", 1e-6, 1e-2),
    choice("average", True, False, 1, 5, 10),
    choice("class_weight", "balanced", None),
    integer("max_iter", 1000, 5000),
)
_RIDGE = (log_uniform("alpha", 1e-5, 100.0), choice("fit_intercept", True, False))
_SVC = (choice("penalty", "l1", "l2"), log_uniform("C", 1e-3, 100.0), log_uniform("tol", 1e-5, 1e-2))
_MLP = (
    integer("n_layers", 1, 2),
    integer("hidden_0", 16, 128, 16),
    integer("hidden_1", 16, 128, 16),
    choice("activation", "relu", "tanh"),
    log_uniform("alpha", 1e-4, 0.1),
    log_uniform("learning_rate_init", 1e-3, 1e-2),
    choice("batch_size", 128, 256, 512),
    log_uniform("tol", 1e-4, 1e-3),
)
_LDA = (
    choice("solver", "svd", "lsqr", "eigen"),
    uniform("shrinkage", 0.0, 1.0, when=("solver", ("lsqr", "eigen"))),
    log_uniform("tol", 1e-5, 1e-3, when=("solver", ("svd",))),
)
_QDA = (uniform("reg_param", 0.0, 1.0), log_uniform("tol", 1e-5, 1e-3))
_KNN = (
    integer("n_components", 2, 10),
    integer("n_neighbors", 3, 30),
    choice("weights", "uniform", "distance"),
    integer("p", 1, 2),
    choice("metric", "euclidean", "manhattan", "minkowski"),
)

LEARNERS = {
    s.name: s
    for s in (
        LearnerSpec("xgboost", _XGB, _xgboost),
        LearnerSpec("lightgbm", _LGBM, _lightgbm),
        LearnerSpec("catboost", _CAT, _catboost, warmup=1, n_jobs=1),
        LearnerSpec("hist_gradient_boosting", _HIST, _hist),
        LearnerSpec("extra_tree", _ET, _extra_trees),
        LearnerSpec("random_forest", _RF, _random_forest),
        LearnerSpec("logistic_regression", _LOGISTIC, _logistic, stacking_space=_LOGISTIC_STACK),
        LearnerSpec("ridge", _RIDGE, _ridge),
        LearnerSpec("sgdclassifier", _SGD, _sgd, stacking_space=_SGD_STACK),
        LearnerSpec("linear_svc", _SVC, _linear_svc),
        LearnerSpec("mlp", _MLP, _mlp, warmup=1),
        LearnerSpec("lda", _LDA, _lda),
        LearnerSpec("qda", _QDA, _qda),
        LearnerSpec("trunsvd_knn", _KNN, _svd_knn),
    )
}

LAYER_ONE = ("xgboost", "lightgbm", "catboost")
LAYER_STACKING = ("xgboost", "catboost", "lightgbm", "sgdclassifier", "logistic_regression")

# Fixed boosters for comparing feature sets (fixed values). No depth limit among 31 leaves means at most 30.
BASELINES = {
    "xgboost": replace(
        BO.DEPTHWISE, rounds=2000, learning_rate=0.03, max_depth=6, subsample=0.8, colsample=0.8, min_child_weight=3.0,
        reg_alpha=0.1, reg_lambda=1.0, max_bins=256,
    ),
    "lightgbm": replace(
        BO.LEAFWISE, rounds=2000, learning_rate=0.03, max_leaves=31, max_depth=30, colsample=0.85, subsample=0.8,
        subsample_every=1, min_child_rows=30.0, reg_alpha=0.1, reg_lambda=1.0, max_bins=255,
    ),
    "catboost": replace(
        BO.SYMMETRIC, rounds=2000, learning_rate=0.03, max_depth=6, reg_lambda=3.0, early_stopping=None, max_bins=254
    ),
}
