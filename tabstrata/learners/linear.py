"""Linear classifiers: proximal gradient, parameter-averaged SGD, and proximal Newton."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.learners.base import (
    ROWS,
    LinearModel,
    ModelRows,
    feature_sets,
    part_of,
    partial_sums,
    scaled_rows,
    training_rows,
)
from tabstrata.learners.mllib import SparkLogistic
from tabstrata.learners.moments import fold_moments, training_moments
from tabstrata.operators.encode import weights_from_counts
from tabstrata.runtime import Steps


_STRIP = 256  # numbers of a vector that are added up in one group


def _held_out(fold, k_folds, whole=True):
    return ([*range(k_folds)] if fold else []) + ([-1] if whole or not fold else [])


def _class_weights(moments, k, mode) -> np.ndarray:
    """(models, K) class weights from each model's training counts."""
    out = np.zeros((len(moments), k))
    for i, m in enumerate(moments):
        w = weights_from_counts({c: v for c, v in enumerate(m.n) if v > 0}, mode)
        out[i] = [w.get(c, 0.0) for c in range(k)]
    return out


def _fold_weights(rows: ModelRows, part: int, held, k_folds: int, mode) -> np.ndarray:
    """(models, K) class weights from the labels outside each model's fold."""
    counts = rows.counts(part, k_folds)
    out = np.zeros((len(held), rows.k))
    for i, j in enumerate(held):
        n = counts.sum(axis=0) - (counts[j] if j >= 0 else 0)
        w = weights_from_counts({c: int(v) for c, v in enumerate(n) if v > 0}, mode)
        out[i] = [w.get(c, 0.0) for c in range(rows.k)]
    return out


class SquaredHingeSVC:
    """Linear SVC with squared hinge loss and an L1 or L2 penalty, one class against the rest.

    Minimises penalty(w) + C * sum_i c_i max(0, 1 - y_i (w x_i + b))**2 with the intercept treated as a constant feature under the
    same penalty. Proximal finite Newton (Keerthi & DeCoste 2005): a pass returns loss, gradient and the Hessian over the rows
    inside the margin, of all models and classes, and the driver solves the small quadratic models; about ten passes. Beyond
    ``WIDE`` features, where Hessians would outgrow the driver, FISTA (Beck & Teboulle 2009) finds the same minimum from gradients.
    Features should be standardised.
    """

    WIDE = 200

    def __init__(self, k, penalty="l2", C=1.0, tol=1e-4, max_iter=5000, class_weight="balanced"):
        self.k, self.penalty, self.C, self.tol = k, penalty, C, tol
        self.max_iter, self.class_weight = max_iter, class_weight

    def fit(self, df, features, label):
        return self.fit_folds(df, features, label, None, 1)[-1]

    def fit_folds(self, df: DataFrame, features, label, fold, k_folds) -> list[LinearModel]:
        k, d = self.k, len(features) + 1
        if self.fits_rows(features):
            rows = ModelRows(df, [list(features)], label, k, [F.coalesce(F.col(fold).cast("int"), F.lit(-2)) if fold else F.lit(-2)])
            try:
                return self.fit_rows(rows, 0, 0, k_folds if fold else 0)
            finally:
                rows.close()
        moments = training_moments(fold_moments(df, features, label, k, fold, k_folds))
        held, weights = _held_out(fold, k_folds), _class_weights(moments, k, self.class_weight)
        n_models = len(held)
        step = np.empty(n_models)
        for i, m in enumerate(moments):
            full = np.zeros((d, d))
            for c in range(k):
                full[:-1, :-1] += weights[i, c] * m.ss[c]
                full[:-1, -1] += weights[i, c] * m.s[c]
                full[-1, -1] += weights[i, c] * m.n[c]
            full[-1, :-1] = full[:-1, -1]
            step[i] = 1.0 / (2.0 * self.C * np.linalg.eigvalsh(full)[-1] + 1.0)
        columns = [*features, label] + ([fold] if fold else [])

        def gradient(v: np.ndarray) -> np.ndarray:
            flat = v.reshape(n_models * k, d)

            def add(pdf: pd.DataFrame, acc: np.ndarray) -> None:
                x = np.column_stack([pdf[features].to_numpy(dtype=np.float64), np.ones(len(pdf))])
                y = pdf[label].to_numpy()
                f = pdf[fold].to_numpy() if fold else None
                mask = training_rows(f, len(y), held)
                sign = np.where(y[:, None] == np.arange(k)[None, :], 1.0, -1.0)
                margin = (x @ flat.T).reshape(len(y), n_models, k) * sign[:, None, :]
                slack = np.maximum(0.0, 1.0 - margin)
                cost = mask[:, :, None] * weights[:, y].T[:, :, None]
                r = (-2.0 * cost * slack * sign[:, None, :]).reshape(len(y), -1)
                acc += (r.T @ x).ravel()

            return self.C * partial_sums(df, columns, add, n_models * k * d).reshape(n_models, k, d)

        w = np.zeros((n_models, k, d))
        z, t = w.copy(), 1.0
        eta = step[:, None, None]
        for _ in range(self.max_iter):
            g = gradient(z)
            if self.penalty == "l2":
                new = (z - eta * g) / (1.0 + eta)
            else:
                u = z - eta * g
                new = np.sign(u) * np.maximum(np.abs(u) - eta, 0.0)
            t_new = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
            z = new + (t - 1.0) / t_new * (new - w)
            change = np.abs(new - w).max() / max(np.abs(new).max(), 1e-12)
            w, t = new, t_new
            if change < self.tol:
                break
        return [LinearModel(features, w[i, :, :-1], w[i, :, -1]) for i in range(n_models)]

    def fits_rows(self, features) -> bool:
        """Whether models of these features are fitted on :class:`ModelRows`."""
        return len(features) + 1 <= self.WIDE

    def fit_rows(self, rows: ModelRows, at: int, part: int, k_folds: int, whole: bool = True) -> list[LinearModel]:
        """The models that leave out a fold each, then that of all rows; the folds are a part of the rows, and features those of
        the model ``at``. Rows of no part are no rows of any model."""
        held = _held_out(k_folds, k_folds, whole)
        weights = _fold_weights(rows, part, held, k_folds, self.class_weight)
        w = self._newton(rows, at, part, held, weights)
        return [LinearModel(rows.sets[at], w[i, :, :-1], w[i, :, -1]) for i in range(len(held))]

    def _newton(self, rows: ModelRows, which: int, part: int, held, weights) -> np.ndarray:
        """(models, K, features + 1) coefficients."""
        n_models, k, scale = len(held), self.k, rows.scales[which]
        d = len(scale[0]) + 1
        size = 1 + d + d * d

        def passes(w: np.ndarray, active: np.ndarray) -> np.ndarray:
            """(models, K, 1 + d + d^2): loss, gradient and Hessian of C times the weighted loss."""
            asked = list(zip(*np.nonzero(active)))
            flat = np.array([w[i, c] for i, c in asked]).T

            def add(batch: pa.RecordBatch, acc: np.ndarray) -> None:
                y, f, kept = part_of(batch, part, rows=True)
                x = np.ascontiguousarray(scaled_rows(batch, scale, kept).T)
                mask = training_rows(f, len(y), held)
                view, margins = acc.reshape(n_models, k, size), x @ flat
                for at, (i, c) in enumerate(asked):
                    sign = np.where(y == c, 1.0, -1.0)
                    slack = 1.0 - sign * margins[:, at]
                    inside = np.flatnonzero(mask[:, i] & (slack > 0.0))
                    near, cost, short = x[inside], weights[i][y[inside]], slack[inside]
                    view[i, c, 0] += (cost * short**2).sum()
                    view[i, c, 1 : 1 + d] += near.T @ (-2.0 * cost * short * sign[inside])
                    view[i, c, 1 + d :] += ((near * (2.0 * cost)[:, None]).T @ near).ravel()

            return self.C * partial_sums(rows.frame, [ROWS], add, n_models * k * size, True).reshape(n_models, k, size)

        ones = np.ones(d)
        l1, l2 = (ones, 0.0 * ones) if self.penalty == "l1" else (0.0 * ones, ones)
        free = np.ones(d, dtype=bool)
        w, step = np.zeros((n_models, k, d)), np.zeros((n_models, k, d))
        value, active = np.full((n_models, k), np.inf), np.ones((n_models, k), dtype=bool)
        for _ in range(self.max_iter):
            out = passes(w + step, active)
            for i, c in zip(*np.nonzero(active)):
                at = w[i, c] + step[i, c]
                new = out[i, c, 0] + (l1 * np.abs(at) + 0.5 * l2 * at * at).sum()
                if new > value[i, c] + 1e-12 * abs(value[i, c]):
                    step[i, c] *= 0.5  # too long a step: try half of it in the next pass
                    active[i, c] = np.abs(step[i, c]).max() > 1e-12
                    continue
                w[i, c], value[i, c] = at, new
                step[i, c] = _penalised_newton(at, out[i, c, 1 : 1 + d], out[i, c, 1 + d :].reshape(d, d), l1, l2, free)
                active[i, c] = np.abs(step[i, c]).max() > self.tol * max(np.abs(at).max(), 1e-12)
            if not active.any():
                break
        return w


class AveragedSGD:
    """Stochastic gradient descent on K one-vs-rest problems, for all models at once.

    Rows are dealt to shards by a hash of their content; each shard is one ordered pass of mini-batch steps from the common
    coefficients, and the coefficients are averaged over shards, weighted by rows, in the order of the shards, after each epoch
    (Zinkevich et al. 2010). Shards, their order and the sums depend on the rows only, so the result is the same, bit by bit,
    however the table is partitioned. Losses: log_loss, modified_huber, hinge, perceptron. Rates: optimal, adaptive, constant,
    invscaling.

    Scale: there is a shard for every ``shard_rows`` rows, eight at least; rows are shuffled once, equal ones as one row with a
    count, which is spread over the shards. A task streams its shards and returns one vector for each.
    """

    def __init__(
        self,
        k,
        loss="log_loss",
        penalty="l2",
        alpha=1e-4,
        l1_ratio=0.15,
        learning_rate="optimal",
        eta0=0.01,
        power_t=0.5,
        epsilon=0.1,
        tol=1e-3,
        average=False,
        class_weight="balanced",
        max_iter=1000,
        n_iter_no_change=5,
        batch=32,
        shard_rows=50_000,
        seed=42,
    ):
        self.__dict__.update({n: v for n, v in locals().items() if n != "self"})

    def fit(self, df, features, label):
        return self.fit_folds(df, features, label, None, 1)[-1]

    def _slope(self, margin):
        """(loss, -d loss / d margin) for y * f = margin."""
        if self.loss == "log_loss":
            p = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))
            return np.logaddexp(0.0, -margin), p
        if self.loss == "modified_huber":
            hinge = np.maximum(0.0, 1.0 - margin)
            far = margin < -1.0
            return np.where(far, -4.0 * margin, hinge**2), np.where(far, 4.0, 2.0 * hinge)
        threshold = 1.0 if self.loss == "hinge" else 0.0
        active = margin <= threshold if self.loss == "perceptron" else margin < threshold
        return np.maximum(0.0, threshold - margin), active.astype(float)

    def _eta(self, t: float, scale: np.ndarray) -> np.ndarray:
        """Learning rate of every model at step ``t``, shaped to multiply (models, K, d)."""
        if self.learning_rate == "optimal":
            typical = np.sqrt(1.0 / np.sqrt(self.alpha))
            rate = np.full_like(scale, 1.0 / (self.alpha * (1.0 / (typical * self.alpha) + t - 1.0)))
        elif self.learning_rate == "invscaling":
            rate = np.full_like(scale, self.eta0 / t**self.power_t)
        else:
            rate = self.eta0 * scale
        return rate[:, None, None]

    def fit_folds(self, df: DataFrame, features, label, fold, k_folds) -> list[LinearModel]:
        k, d = self.k, len(features)
        held = _held_out(fold, k_folds)
        n_models = len(held)
        moments = training_moments(fold_moments(df, features, label, k, fold, k_folds))
        weights = _class_weights(moments, k, self.class_weight)
        l1 = {"l1": 1.0, "l2": 0.0}.get(self.penalty, self.l1_ratio)
        n_rows = int(moments[-1].n.sum())
        if not n_rows:
            raise ValueError("no rows to learn from")
        steps = Steps(df.sparkSession, "rows")
        shards = self._deal(df, features, label, fold, max(8, -(-n_rows // self.shard_rows)), steps).persist()
        spec = self

        def epoch(coef: np.ndarray, t0: float, scale: np.ndarray) -> np.ndarray:
            """Row-weighted sum over shards of (coefficients, average), plus loss, rows, steps."""

            class Pass:
                """One pass over a shard; rows wait until they fill a mini-batch."""

                def __init__(self, shard: int):
                    self.shard, self.w, self.loss = shard, coef.copy(), np.zeros(n_models)
                    self.mean, self.count, self.steps = np.zeros_like(coef), 0, 0
                    self.rest = np.zeros((0, d + 3))

                def add(self, rows: np.ndarray) -> None:
                    rows = np.concatenate([self.rest, rows])
                    full = len(rows) - len(rows) % spec.batch
                    for a in range(0, full, spec.batch):
                        self.step(rows[a : a + spec.batch])
                    self.rest = rows[full:]

                def step(self, rows: np.ndarray) -> None:
                    x = rows[:, : d + 1].copy()
                    y, f = rows[:, d + 1].astype(int), rows[:, d + 2]
                    w = self.w
                    mask = training_rows(f if fold else None, len(y), held)
                    sign = np.where(y[:, None] == np.arange(k)[None, :], 1.0, -1.0)
                    margin = np.einsum("nd,mkd->nmk", x, w) * sign[:, None, :]
                    value, slope = spec._slope(margin)
                    cost = mask * weights[:, y].T
                    self.loss += (cost[:, :, None] * value).sum(axis=(0, 2))
                    pull = cost[:, :, None] * slope * sign[:, None, :]
                    grad = np.einsum("nmk,nd->mkd", pull, x) / len(y)
                    # a mini-batch step replaces len(y) single ones; a longer stride, bounded
                    eta = np.minimum(spec._eta(t0 + self.steps + 1.0, scale) * min(len(y), 8), 1.0)
                    w[:, :, :-1] *= np.maximum(0.0, 1.0 - eta * spec.alpha * (1.0 - l1))
                    w += eta * grad
                    if l1:
                        cut = eta * spec.alpha * l1
                        body = w[:, :, :-1]
                        w[:, :, :-1] = np.sign(body) * np.maximum(np.abs(body) - cut, 0.0)
                    self.steps += len(y)
                    self.count += 1
                    self.mean += (w - self.mean) / self.count

                def close(self) -> pa.RecordBatch:
                    if len(self.rest):
                        self.step(self.rest)
                    n = self.steps
                    flat = np.concatenate([self.w.ravel() * n, self.mean.ravel() * n, self.loss, [n, n]])
                    strips = [flat[a : a + _STRIP] for a in range(0, len(flat), _STRIP)]
                    shard = pa.array(np.full(len(strips), self.shard, dtype=np.int64))
                    at = pa.array(np.arange(len(strips)))
                    return pa.RecordBatch.from_arrays([shard, at, pa.array(strips, pa.list_(pa.float64()))], names=["shard", "strip", "v"])

            def run(batches):
                current = None
                for batch in batches:
                    shard, times = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)]
                    rows = np.column_stack([*columns[:d], np.ones(len(shard)), *columns[d:]])
                    for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                        if not len(part):
                            continue
                        if current is None or current.shard != shard[part[0]]:
                            if current is not None:
                                yield current.close()
                            current = Pass(int(shard[part[0]]))
                        current.add(rows[np.repeat(part, times[part])])
                if current is not None:
                    yield current.close()

            def total(pdf: pd.DataFrame) -> pd.DataFrame:
                stacked = np.stack(pdf.sort_values("shard")["v"].to_list())
                return pd.DataFrame({"strip": pdf["strip"].iloc[:1], "v": [np.cumsum(stacked, axis=0)[-1]]})

            parts = shards.mapInArrow(run, "shard long, strip long, v array<double>")
            sums = parts.groupBy("strip").applyInPandas(total, "strip long, v array<double>").toPandas()
            return np.concatenate(sums.sort_values("strip")["v"].to_list())

        try:
            return self._epochs(epoch, n_models, k, d, features)
        finally:
            shards.unpersist()
            steps.close()

    def _deal(self, df, features, label, fold, n_shards: int, steps: Steps) -> DataFrame:
        """(shard, times, features..., label, fold), each shard whole and in order inside one partition."""
        x = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
        rest = [F.col(f"`{label}`").cast("double").alias("y"), (F.col(f"`{fold}`") if fold else F.lit(-2)).cast("double").alias("f")]
        names = [f"x{i}" for i in range(len(features))] + ["y", "f"]
        # equal rows are counted before they are shuffled; the i-th share of a row goes to the i-th shard from its own
        rows = df.select(*x, *rest).groupBy(*names).agg(F.count("*").alias("n"))
        share = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(n_shards).cast("long")) - 1))
        rows = steps.write(rows.withColumn("h", F.xxhash64(F.lit(self.seed), *names))).withColumn("i", share)
        times = F.expr(f"n div {n_shards} + int(i < n % {n_shards})").cast("long")
        shard = F.expr(f"pmod(pmod(h, {n_shards}) + i, {n_shards})")
        rows = rows.select(shard.alias("shard"), times.alias("times"), *names, F.xxhash64("h", "i").alias("order"))
        return rows.repartition("shard").sortWithinPartitions("shard", "order", *names).drop("order")

    def _epochs(self, epoch, n_models: int, k: int, d: int, features) -> list[LinearModel]:
        size = (d + 1) * k * n_models
        shape = (n_models, k, d + 1)
        w, seen, scale = np.zeros(shape), 0.0, np.ones(n_models)
        average, averaged = np.zeros(shape), 0
        best, stale = np.full(n_models, np.inf), np.zeros(n_models, dtype=int)
        done = np.zeros(n_models, dtype=bool)
        start_avg = 1 if self.average is True else int(self.average or 0)
        for _ in range(self.max_iter):
            out = epoch(w, seen, scale)
            rows = out[-2]
            new = (out[:size] / rows).reshape(shape)
            mean = (out[size : 2 * size] / rows).reshape(shape)
            loss = out[2 * size : 2 * size + n_models] / rows
            w = np.where(done[:, None, None], w, new)
            seen += rows
            if start_avg and seen >= start_avg:
                averaged += 1
                average += (np.where(done[:, None, None], average, mean) - average) / averaged
            worse = loss > best - self.tol
            stale = np.where(worse, stale + 1, 0)
            best = np.minimum(best, loss)
            stalled = stale >= self.n_iter_no_change
            if self.learning_rate == "adaptive":
                scale = np.where(stalled, scale / 5.0, scale)
                stale = np.where(stalled, 0, stale)
                done |= scale * self.eta0 <= 1e-6
            else:
                done |= stalled
            if done.all():
                break
        final = average if start_avg else w
        link = self.loss if self.loss in ("log_loss", "modified_huber") else "softmax"
        return [LinearModel(features, final[i, :, :-1], final[i, :, -1], link) for i in range(n_models)]


class ElasticNetLogistic:
    """Multinomial logistic regression, penalty (1/C) * elastic net on the summed weighted loss.

    Proximal Newton: one pass over the data returns loss, gradient and Hessian of all folds and
    classes, and the driver solves the small penalised quadratic model. It needs a handful of passes
    where a first-order solver needs dozens per fold, which is what counts when a pass is a scan of
    the whole table. Beyond ``WIDE`` coefficients the Hessian would outgrow the driver, and Spark's
    own solver takes over, fold by fold.
    """

    WIDE = 600
    feature_lists = folds_only = True

    def __init__(self, k, C=1.0, l1_ratio=0.0, class_weight=None, fit_intercept=True, tol=1e-6, max_iter=1000):
        self.k, self.C, self.l1_ratio, self.class_weight = k, C, l1_ratio, class_weight
        self.fit_intercept, self.tol, self.max_iter = fit_intercept, tol, max_iter

    def fit(self, df, features, label):
        return self.fit_folds(df, features, label, None, 1)[-1]

    def fit_folds(self, df: DataFrame, features, label, fold, k_folds, whole: bool = True) -> list[LinearModel]:
        """``features``: one list, or one for each model; without ``whole`` the model of all rows is left out."""
        k, held = self.k, _held_out(fold, k_folds, whole)
        sets = feature_sets(features, len(held))
        d, n_models = len(sets[0]) + 1, len(held)
        if k * d > self.WIDE:
            spark_fit = SparkLogistic(
                k, self.C, self.l1_ratio, self.class_weight, self.fit_intercept, self.tol, self.max_iter
            )
            parts = [df if j < 0 else df.where(F.col(fold) != j) for j in held]
            return [spark_fit.fit(part, own, label) for part, own in zip(parts, sets)]
        rows = ModelRows(df, sets, label, k, [F.coalesce(F.col(fold).cast("int"), F.lit(-2)) if fold else F.lit(-2)])
        try:
            coef = self._newton(rows, held, k_folds, d).reshape(n_models, k, d)
        finally:
            rows.close()
        return [LinearModel(own, coef[i, :, :-1], coef[i, :, -1]) for i, own in enumerate(sets)]

    def _newton(self, rows: ModelRows, held, k_folds: int, d: int) -> np.ndarray:
        """(models, K (features + 1)) coefficients."""
        k, n_models, size = self.k, len(held), 1 + self.k * d + (self.k * d) ** 2
        weights = _fold_weights(rows, 0, held, k_folds, self.class_weight)
        pairs, scales = [(a, b) for a in range(k) for b in range(a, k)], rows.scales

        def passes(w: np.ndarray, active: np.ndarray) -> np.ndarray:
            """(models, 1 + Kd + (Kd)^2): loss, gradient and Hessian of the weighted loss."""

            def add(batch: pa.RecordBatch, acc: np.ndarray) -> None:
                y_all, part = part_of(batch, 0)
                mask = training_rows(part, len(y_all), held)
                view = acc.reshape(n_models, size)
                for i in np.flatnonzero(active):
                    kept = np.flatnonzero(mask[:, i])
                    x, y, at = scaled_rows(batch, scales[i], kept), y_all[kept], np.arange(len(kept))
                    c = weights[i][y]
                    m = w[i] @ x
                    m -= m.max(axis=0)
                    p = np.exp(m)
                    s = p.sum(axis=0)
                    p /= s
                    view[i, 0] += (c * (np.log(s) - m[y, at])).sum()
                    r = p.copy()
                    r[y, at] -= 1.0
                    view[i, 1 : 1 + k * d] += ((r * c) @ x.T).ravel()
                    hess = view[i, 1 + k * d :].reshape(k, d, k, d)
                    for a, b in pairs:
                        block = (x * (c * p[a] * ((1.0 if a == b else 0.0) - p[b]))) @ x.T
                        hess[a, :, b, :] += block
                        if a != b:
                            hess[b, :, a, :] += block.T

            return partial_sums(rows.frame, [ROWS], add, n_models * size, True).reshape(n_models, size)

        penalised = np.tile(np.append(np.ones(d - 1), 0.0), k)
        l1 = penalised * self.l1_ratio / self.C
        l2 = penalised * (1.0 - self.l1_ratio) / self.C
        free = np.ones(k * d, dtype=bool)
        if not self.fit_intercept:
            free = penalised > 0

        def penalty(v):
            return (l1 * np.abs(v)).sum() + 0.5 * (l2 * v * v).sum()

        w = np.zeros((n_models, k * d))
        step = np.zeros_like(w)
        value = np.full(n_models, np.inf)
        active = np.ones(n_models, dtype=bool)
        for _ in range(self.max_iter):
            out = passes((w + step).reshape(n_models, k, d), active)
            for i in np.flatnonzero(active):
                new = out[i, 0] + penalty(w[i] + step[i])
                if new > value[i] + 1e-12 * abs(value[i]):
                    step[i] *= 0.5  # too long a step: try half of it in the next pass
                    active[i] = np.abs(step[i]).max() > 1e-12
                    continue
                gain = value[i] - new
                w[i] += step[i]
                value[i] = new
                if gain < self.tol * max(abs(new), 1e-12):
                    active[i] = False
                    step[i] = 0.0
                    continue
                g = out[i, 1 : 1 + k * d]
                h = out[i, 1 + k * d :].reshape(k * d, k * d)
                step[i] = _penalised_newton(w[i], g, h, l1, l2, free)
            if not active.any():
                break
        return w


def _penalised_newton(w, g, h, l1, l2, free) -> np.ndarray:
    """Step minimising g's + s'Hs/2 + elastic net of (w + s), over the free coordinates."""
    out = np.zeros_like(w)
    w, g, l1, l2 = w[free], g[free], l1[free], l2[free]
    h = h[np.ix_(free, free)]
    # softmax coefficients are defined up to a common shift; a little ridge picks one
    h = h + (1e-9 * np.trace(h) / len(w) + 1e-12) * np.eye(len(w))
    smooth = h + np.diag(l2)
    if not l1.any():
        out[free] = np.linalg.solve(smooth, -(g + l2 * w))
        return out
    # alternating directions (Boyd et al. 2011): the linear part exactly, the L1 part by thresholding
    rho = float(np.exp(np.mean(np.log(np.clip(np.linalg.eigvalsh(smooth), 1e-9, None)))))
    inverse = np.linalg.inv(smooth + rho * np.eye(len(w)))
    target, v, u = h @ w - g, w.copy(), np.zeros_like(w)
    for _ in range(2_000):
        x = inverse @ (target + rho * (v - u))
        moved = 1.6 * x - 0.6 * v
        last, v = v, np.sign(moved + u) * np.maximum(np.abs(moved + u) - l1 / rho, 0.0)
        u += moved - v
        if max(np.abs(x - v).max(), np.abs(v - last).max()) <= 1e-9 * max(np.abs(v).max(), 1e-9):
            break
    # with the signs settled the rest is a linear system
    on = (v != 0) | (l1 == 0)
    exact = np.linalg.solve(smooth[np.ix_(on, on)], (h @ w - g)[on] - (l1 * np.sign(v))[on])
    if (np.sign(exact) == np.sign(v[on]))[l1[on] > 0].all():
        v[on] = exact
    out[free] = v - w
    return out
