"""Closed-form learners from class moments: discriminant analysis and ridge classification.

One aggregation returns n, sum x and sum x x' per (fold, class). The training statistics of a fold
are the totals minus its own, balanced weights multiply a class as a whole, so every fold of every
learner here (and standardisation) follows from the same table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.learners.base import (
    LinearModel,
    Model,
    partial_sums,
    refuse,
    require_complete,
    softmax_array,
    softmax_texts,
)
from tabstrata.operators.encode import weights_from_counts
from tabstrata.runtime import small_rows

_EXPRESSION_LIMIT = 8
#: Features up to which all centred products are aggregates of one scan.
_ONE_PASS = 4


class ClassMoments:
    """Counts n (K) and the sums of one training set about a common ``origin`` (d): ds (K, d), dss (K, d, d).

    Sums about a point near the mean keep their digits where raw sums of squares would cancel.
    """

    def __init__(self, n, ds, dss, origin):
        self.n, self.ds, self.dss, self.origin = n, ds, dss, origin

    @property
    def k(self):
        return len(self.n)

    def __sub__(self, o):
        return ClassMoments(self.n - o.n, self.ds - o.ds, self.dss - o.dss, self.origin)

    def __add__(self, o):
        return ClassMoments(self.n + o.n, self.ds + o.ds, self.dss + o.dss, self.origin)

    @property
    def s(self):
        """Sums of x."""
        return self.ds + self.n[:, None] * self.origin

    @property
    def ss(self):
        """Sums of x x'."""
        cross = self.ds[:, :, None] * self.origin
        square = np.multiply.outer(self.n, np.outer(self.origin, self.origin))
        return self.dss + cross + np.swapaxes(cross, 1, 2) + square

    def means(self):
        return self.origin + self.ds / np.maximum(self.n, 1.0)[:, None]

    def scatter(self):
        """Centred sums of squares per class."""
        d = self.ds / np.maximum(self.n, 1.0)[:, None]
        return self.dss - self.n[:, None, None] * d[:, :, None] * d[:, None, :]


def fold_moments(
    df: DataFrame, features: list[str], label: str, k: int, fold: str | None = None, k_folds: int = 1
) -> list[ClassMoments]:
    """Moments of every fold's own rows about the mean of all rows.

    Few features take one pass, of means, centred products and missing values by (fold, class). More take a scan
    for the mean, which also refuses missing values (:func:`require_complete`), and a pass for the sums.
    """
    d = len(features)
    if d <= _ONE_PASS:
        return _one_pass_moments(df, features, label, k, fold, k_folds)
    origin = require_complete(df, features, label, k)
    n, s, ss = np.zeros((k_folds, k)), np.zeros((k_folds, k, d)), np.zeros((k_folds, k, d, d))
    if d <= _EXPRESSION_LIMIT:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        aggs = [F.expr("count(1) as n")]
        x = [f"(`{c}` - {float(o)!r}D)" for c, o in zip(features, origin)]
        aggs += [F.expr(f"sum({x[i]}) as s{i}") for i in range(d)]
        aggs += [F.expr(f"sum({x[i]} * {x[j]}) as q{i}_{j}") for i, j in pairs]
        keys = [F.col(fold).alias("__f") if fold else F.lit(0).alias("__f"), F.col(label).alias("__y")]
        for r in df.groupBy(*keys).agg(*aggs).collect():  # k_folds x K rows
            f, c = r["__f"], r["__y"]
            n[f, c] = r["n"]
            s[f, c] = [r[f"s{i}"] for i in range(d)]
            for i, j in pairs:
                ss[f, c, i, j] = ss[f, c, j, i] = r[f"q{i}_{j}"]
    else:
        size = 1 + d + d * d

        def add(pdf, acc):
            x = pdf[features].to_numpy(dtype=np.float64) - origin
            y = pdf[label].to_numpy()
            f = pdf[fold].to_numpy() if fold else np.zeros(len(y), dtype=int)
            view = acc.reshape(k_folds, k, size)
            for j in range(k_folds):
                for c in range(k):
                    part = x[(f == j) & (y == c)]
                    view[j, c, 0] += len(part)
                    view[j, c, 1 : 1 + d] += part.sum(axis=0)
                    view[j, c, 1 + d :] += (part.T @ part).ravel()

        cols = [*features, label] + ([fold] if fold else [])
        flat = partial_sums(df, cols, add, k_folds * k * size).reshape(k_folds, k, size)
        n, s = flat[:, :, 0], flat[:, :, 1 : 1 + d]
        ss = flat[:, :, 1 + d :].reshape(k_folds, k, d, d)
    return [ClassMoments(n[f], s[f], ss[f], origin) for f in range(k_folds)]


def _one_pass_moments(df, features, label, k, fold, k_folds) -> list[ClassMoments]:
    d = len(features)
    x = [F.col(f"`{c}`").cast("double") for c in features]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"a{i}") for i, c in enumerate(x)]
    aggs += [(F.var_pop(x[i]) if i == j else F.covar_pop(x[i], x[j])).alias(f"q{i}_{j}") for i, j in pairs]
    aggs += [F.count_if(c.isNull() | F.isnan(c)).alias(f"m{i}") for i, c in enumerate(x)]
    keys = [F.col(fold).alias("__f") if fold else F.lit(0).alias("__f"), F.col(f"`{label}`").alias("__y")]
    rows = small_rows(df.groupBy(*keys).agg(*aggs), 100_000, "fold and class counts")
    outside = sum(r["n"] for r in rows if r["__y"] is None or not 0 <= r["__y"] < k)
    refuse({c: sum(r[f"m{i}"] for r in rows) for i, c in enumerate(features)}, outside, label)
    n, mean, cov = np.zeros((k_folds, k)), np.zeros((k_folds, k, d)), np.zeros((k_folds, k, d, d))
    for r in rows:
        f, c = r["__f"], r["__y"]
        n[f, c], mean[f, c] = r["n"], [r[f"a{i}"] for i in range(d)]
        for i, j in pairs:
            cov[f, c, i, j] = cov[f, c, j, i] = r[f"q{i}_{j}"]
    origin = (n[..., None] * mean).sum(axis=(0, 1)) / max(n.sum(), 1.0)
    off = mean - origin
    s = n[..., None] * off
    ss = n[..., None, None] * (cov + off[..., :, None] * off[..., None, :])
    return [ClassMoments(n[f], s[f], ss[f], origin) for f in range(k_folds)]


def training_moments(parts: list[ClassMoments]) -> list[ClassMoments]:
    """Per fold the moments of the other folds, then those of all rows."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [total - p for p in parts] + [total] if len(parts) > 1 else [total]


# linear discriminant ------------------------------------------------------------------------------
def lda(m: ClassMoments, features, solver: str = "svd", shrinkage: float | None = None, tol=1e-4):
    """``svd`` pools with divisor n - K; ``lsqr`` / ``eigen`` use the prior-weighted class
    covariances (divisor n_k) shrunk towards a multiple of the identity."""
    n, mu = m.n.sum(), m.means()
    prior = np.maximum(m.n, 1e-300) / n
    d = len(features)
    if solver == "svd":
        cov = m.scatter().sum(axis=0) / max(n - m.k, 1.0)
        sd = np.sqrt(np.diag(cov))
        sd[sd == 0] = 1.0
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        keep = np.sqrt(np.maximum(values, 0.0)) > tol
        basis = vectors[:, keep] / sd[:, None] / np.sqrt(values[keep])
        coef = mu @ basis @ basis.T
    else:
        s = shrinkage or 0.0
        cov = np.zeros((d, d))
        for p, sc, nk in zip(prior, m.scatter(), m.n):
            c = sc / max(nk, 1.0)
            cov += p * ((1 - s) * c + s * np.trace(c) / d * np.eye(d))
        coef = np.linalg.lstsq(cov, mu.T, rcond=None)[0].T
    intercept = -0.5 * (mu * coef).sum(axis=1) + np.log(prior)
    return LinearModel(features, coef, intercept)


# quadratic discriminant ---------------------------------------------------------------------------
class QuadraticModel(Model):
    def __init__(self, features, mu, precision, const):
        self.features, self.mu, self.precision, self.const = list(features), mu, precision, const
        self.k = len(mu)

    def predict_array(self, x):
        m = np.empty((len(x), self.k))
        for c in range(self.k):
            z = x - self.mu[c]
            m[:, c] = self.const[c] - 0.5 * np.einsum("ij,jk,ik->i", z, self.precision[c], z)
        return softmax_array(m)

    def expressions(self):
        d = len(self.features)
        if d > 3:
            return None
        texts = []
        for c in range(self.k):
            z = [f"(`{f}` - {float(v)!r}D)" for f, v in zip(self.features, self.mu[c])]
            terms = [
                f"{float(-0.5 * self.precision[c][i, j])!r}D * {z[i]} * {z[j]}"
                for i in range(d)
                for j in range(d)
            ]
            texts.append(" + ".join([f"{float(self.const[c])!r}D", *terms]))
        return softmax_texts(texts)


def qda(m: ClassMoments, features, reg_param: float = 0.0, tol: float = 1e-4):
    """Class covariance (1 - r) S + r I with divisor n_k - 1, plus log-determinant and prior.

    Directions whose deviation is at most ``tol`` get a unit variance floor of tol squared.
    """
    n, mu, d = m.n.sum(), m.means(), len(features)
    precision, const = np.empty((m.k, d, d)), np.empty(m.k)
    for c, sc in enumerate(m.scatter()):
        values, vectors = np.linalg.eigh(sc / max(m.n[c] - 1.0, 1.0))
        values = np.maximum((1 - reg_param) * np.maximum(values, 0.0) + reg_param, tol**2)
        precision[c] = (vectors / values) @ vectors.T
        const[c] = np.log(max(m.n[c], 1e-300) / n) - 0.5 * np.log(values).sum()
    return QuadraticModel(features, mu, precision, const)


# ridge --------------------------------------------------------------------------------------------
def ridge(m: ClassMoments, features, alpha: float = 1.0, fit_intercept=True, class_weight="balanced"):
    """One-vs-rest least squares on +-1 targets with an L2 penalty, solved for all classes at once."""
    w = weights_from_counts({c: v for c, v in enumerate(m.n) if v > 0}, class_weight)
    wk = np.array([w.get(c, 0.0) for c in range(m.k)])
    # an intercept absorbs the origin, without one the sums must be raw
    s, ss = (m.ds, m.dss) if fit_intercept else (m.s, m.ss)
    gram = np.tensordot(wk, ss, axes=1)
    sx, sw = wk @ s, float(wk @ m.n)
    target = 2.0 * np.eye(m.k) - 1.0  # target[c, k]: +1 for the own class, -1 otherwise
    xy = (wk[:, None] * s).T @ target  # (d, K)
    sy = (wk * m.n) @ target
    d = len(features)
    if fit_intercept:
        gram = gram - np.outer(sx, sx) / sw
        xy = xy - np.outer(sx, sy) / sw
    coef = np.linalg.solve(gram + alpha * np.eye(d), xy).T
    intercept = (sy - coef @ sx) / sw - coef @ m.origin if fit_intercept else np.zeros(m.k)
    return LinearModel(features, coef, intercept)


class MomentLearner:
    """``fit_folds`` returns the fold models and the model of all rows from a single pass."""

    SOLVERS = {"lda": lda, "qda": qda, "ridge": ridge}

    def __init__(self, kind: str, k: int, **params):
        self.kind, self.k, self.params = kind, k, params

    def fit(self, df: DataFrame, features, label) -> Model:
        m = training_moments(fold_moments(df, features, label, self.k))[-1]
        return self.SOLVERS[self.kind](m, features, **self.params)

    def fit_folds(self, df: DataFrame, features, label, fold: str, k_folds: int) -> list[Model]:
        parts = fold_moments(df, features, label, self.k, fold, k_folds)
        return [self.SOLVERS[self.kind](m, features, **self.params) for m in training_moments(parts)]
