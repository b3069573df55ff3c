"""Multilayer perceptron with a softmax output, trained for all folds in the same passes.

Back-propagation is a sum over rows: a pass returns the gradients, the training loss and the hold-out loss of
all models, and the driver, which keeps the weights and Adam's moments (Kingma & Ba 2015), takes one step for
each. Hidden units are relu or tanh; ``alpha`` penalises squared weights; a hash of the key holds out
``validation_fraction`` of a model's rows, and a model whose hold-out loss has not fallen by ``tol`` for
``n_iter_no_change`` steps stops and keeps its best weights. The first weights depend on the seed only.

Every step sees all rows, so the result does not depend on partitioning; mini-batches of a few hundred rows
have no counterpart here, which is made up for by larger steps (`learning_rate_init`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.functions.hashing import unit_hash
from tabstrata.learners.base import (
    ROWS,
    Model,
    block_of,
    compact,
    feature_sets,
    numbers,
    partial_sums,
    require_complete_blocks,
    softmax_array,
    sources,
    training_rows,
)
from tabstrata.runtime import bounded_batches


def shapes(sizes) -> list[tuple[int, int]]:
    """(inputs + 1, outputs) of each layer; the last row of a layer's weights is its bias."""
    return [(a + 1, b) for a, b in zip(sizes[:-1], sizes[1:])]


def layers(flat: np.ndarray, sizes) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in shapes(sizes):
        out.append(flat[at : at + a * b].reshape(a, b))
        at += a * b
    return out


def forward(weights, x: np.ndarray, activation: str) -> list[np.ndarray]:
    """Activations of all layers, from the inputs to the class probabilities."""
    out = [x]
    for i, w in enumerate(weights):
        z = out[-1] @ w[:-1] + w[-1]
        if i == len(weights) - 1:
            out.append(softmax_array(z))
        else:
            out.append(np.maximum(z, 0.0) if activation == "relu" else np.tanh(z))
    return out


def gradient(weights, x: np.ndarray, y: np.ndarray, activation: str) -> tuple[float, np.ndarray]:
    """Summed log loss of some rows and its gradient, flattened."""
    loss, _, flat = losses(weights, np.ascontiguousarray(x.T), y, np.ones(len(y)), np.zeros(len(y)), activation)
    return loss, flat


def losses(weights, x: np.ndarray, y: np.ndarray, train: np.ndarray, aside: np.ndarray, activation: str):
    """Summed log loss of the rows of weight one in ``train``, that of those in ``aside``, and the first one's gradient.

    ``x`` has a row for each feature: numbers that are worked on together lie next to each other.
    """
    acts, rows = [x], np.arange(len(y))
    for i, w in enumerate(weights):
        z = w[:-1].T @ acts[-1]
        z += w[-1][:, None]
        if i == len(weights) - 1:
            z -= z.max(0)
            np.exp(z, out=z)
            z /= z.sum(0)
        elif activation == "relu":
            np.maximum(z, 0.0, out=z)
        else:
            np.tanh(z, out=z)
        acts.append(z)
    delta = acts[-1]
    cost = -np.log(np.maximum(delta[y, rows], 1e-15))
    delta[y, rows] -= 1.0
    delta *= train
    parts = []
    for i in range(len(weights) - 1, -1, -1):
        parts.append(np.vstack([acts[i] @ delta.T, delta.sum(1)]).ravel())
        if i:
            delta = weights[i][:-1] @ delta
            delta *= acts[i] > 0 if activation == "relu" else 1.0 - acts[i] ** 2
    return float(cost @ train), float(cost @ aside), np.concatenate(parts[::-1])


class PerceptronModel(Model):
    def __init__(self, features, k: int, sizes, activation: str, flat: np.ndarray):
        self.features, self.k, self.sizes = list(features), k, [int(s) for s in sizes]
        self.activation, self.flat = activation, flat

    def predict_array(self, x):
        return forward(layers(self.flat, self.sizes), x, self.activation)[-1]


class Perceptron:
    """``fit_folds`` trains the fold models and the full model together. ``features`` may be one list, or one
    list for each model (columns scaled for that model); they should be standardised."""

    feature_lists = True  # each model may have columns of its own

    def __init__(
        self, k, hidden=(32,), activation="relu", alpha=1e-4, learning_rate_init=1e-3, tol=1e-4, max_iter=1000,
        early_stopping=True, n_iter_no_change=10, validation_fraction=0.1, seed=42, key="id",
    ):
        self.__dict__.update({n: v for n, v in locals().items() if n != "self"})
        if activation not in ("relu", "tanh"):
            raise ValueError(f"unknown activation {activation!r}")

    def fit(self, df: DataFrame, features, label) -> PerceptronModel:
        return self.fit_folds(df, features, label, None, 0)[-1]

    def fit_folds(self, df: DataFrame, features, label, fold: str | None, k_folds: int) -> list[PerceptronModel]:
        held = ([*range(k_folds)] if fold else []) + [-1]
        sets = feature_sets(features, len(held))
        columns = list(dict.fromkeys(c for s in sets for c in s))
        own = [np.array([columns.index(c) for c in s]) for s in sets]
        sizes = [len(sets[0]), *map(int, self.hidden), self.k]
        key = F.col(self.key) if self.key in df.columns else F.xxhash64(*columns, label)
        read, spots, middle, spread = sources(columns)
        names = [f"x{i}" for i in range(len(read))] + ["y", "fold", "aside"]

        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    xs = [c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns[: len(read)]]
                    rest = batch.columns[len(read) :]
                    yield block_of(pa.RecordBatch.from_arrays([*map(compact, xs), *rest], names=names))

        out = key.isNotNull() & (unit_hash(f"{self.seed}|holdout", key) < self.validation_fraction)
        y = F.col(f"`{label}`")
        rows = df.select(
            *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(read)],
            F.when((y >= 0) & (y < self.k), y.cast("int")).otherwise(-1).alias("__y"),
            (F.col(fold).cast("int") if fold else F.lit(-2)).alias("__fold"),
            (out if self.early_stopping else F.lit(False)).cast("byte").alias("__out"),
        )
        state = bounded_batches(rows).mapInArrow(pack, f"{ROWS} binary").persist()
        try:
            require_complete_blocks(state, {c: f"x{s}" for c, s in zip(columns, spots)}, "y", label)
            scaled = [(spots[o], middle[o][:, None], spread[o][:, None]) for o in own]
            flat = self._train(state, held, scaled, sizes, len(read))
        finally:
            state.unpersist()
        return [PerceptronModel(s, self.k, sizes, self.activation, w) for s, w in zip(sets, flat)]

    def _start(self, sizes) -> np.ndarray:
        """Uniform weights bounded by the widths of the layers they join (Glorot & Bengio 2010)."""
        rng = np.random.default_rng(self.seed)
        bounds = [(a, b, np.sqrt(6.0 / (a - 1 + b))) for a, b in shapes(sizes)]
        return np.concatenate([rng.uniform(-u, u, a * b) for a, b, u in bounds])

    def _sums(self, state, held, own, sizes, width, flat, active) -> np.ndarray:
        """(models, parameters + 4): gradient, training loss and rows, hold-out loss and rows."""
        p, activation = flat.shape[1], self.activation

        def add(batch, acc):
            raw = np.stack([numbers(batch.column(i)) for i in range(width)])
            y, aside = batch.column("y").to_numpy(), batch.column("aside").to_numpy() > 0
            mask = training_rows(batch.column("fold").to_numpy(), len(y), held)
            view = acc.reshape(len(held), p + 4)
            for i in active:
                spots, middle, spread = own[i]
                x = raw[spots]
                x -= middle
                x /= spread
                train, out = (mask[:, i] & ~aside).astype(np.float64), (mask[:, i] & aside).astype(np.float64)
                loss, watched, g = losses(layers(flat[i], sizes), x, y, train, out, activation)
                view[i, :p] += g
                view[i, p:] += loss, train.sum(), watched, out.sum()

        return partial_sums(state, [ROWS], add, len(held) * (p + 4), True).reshape(len(held), p + 4)

    def _train(self, state, held, own, sizes, width) -> np.ndarray:
        start = self._start(sizes)
        flat = np.tile(start, (len(held), 1))
        penalised = np.concatenate([np.r_[np.ones((a - 1) * b), np.zeros(b)] for a, b in shapes(sizes)])
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        best, kept, waited = np.full(len(held), np.inf), flat.copy(), np.zeros(len(held), int)
        active, p = list(range(len(held))), flat.shape[1]
        for step in range(1, self.max_iter + 2):
            sums = self._sums(state, held, own, sizes, width, flat, active)
            for i in list(active):
                n = max(sums[i, p + 1], 1.0)
                penalty = self.alpha * (penalised * flat[i] ** 2).sum() / (2.0 * n)
                watched = sums[i, p + 2] / sums[i, p + 3] if sums[i, p + 3] else sums[i, p] / n + penalty
                waited[i] = waited[i] + 1 if watched > best[i] - self.tol else 0
                if watched < best[i]:
                    best[i], kept[i] = watched, flat[i]
                if waited[i] >= self.n_iter_no_change or step > self.max_iter:
                    active.remove(i)
                    continue
                g = (sums[i, :p] + self.alpha * penalised * flat[i]) / n
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                move = (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                flat[i] -= self.learning_rate_init * move
            if not active:
                break
        return kept
