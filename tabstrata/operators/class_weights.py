"""Per-class probability weights that maximise balanced accuracy.

Scaling all weights leaves the argmax unchanged, so only the K-1 ratios to class 0 are searched: a log-spaced grid of positive
candidates is scored for all folds in one pass, then finer grids are laid around each fold's best. Whole grids are scored from
counts of cells (:mod:`tabstrata.operators.weight_cells`); lists of other candidates by pairing each row with every candidate,
folded into confusion counts map-side. The training counts of a fold are the totals minus the fold's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstrata.functions import proba as P
from tabstrata.operators.folds import plain_folds
from tabstrata.operators.metrics import balanced_accuracy, confusion
from tabstrata.operators.weight_cells import grid_scores, grid_size, grid_weights


def log_grid(k: int, half: int = 4, unit: float = 1.0, center: list[float] | None = None) -> list[list[float]]:
    """Weight vectors (w_0 = center_0) with ratios 2**(unit * e), e in -half..half, for all classes."""
    centers = [center or [1.0] * k]
    return [grid_weights(i, centers, half, unit) for i in range(grid_size(k, half))]


def axis_grid(k: int, half: int = 4, unit: float = 1.0, center: list[float] | None = None) -> list[list[float]]:
    """The center and the vectors that vary one class of it by 2**(unit * e), e in -half..half."""
    center = center or [1.0] * k
    steps = [2.0 ** (unit * e) for e in range(-half, half + 1) if e]
    return [list(center)] + [[c * s if i == j else c for i, c in enumerate(center)] for j in range(1, k) for s in steps]


def candidate_array(candidates: list[list[float]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("cand"), *[F.lit(float(w)).alias(f"w{k}") for k, w in enumerate(ws)])
            for i, ws in enumerate(candidates)
        ]
    )


def score_candidates(
    df: DataFrame, label: str, ps: list[str], candidates, by: list[str], merge_equal: bool = False
) -> DataFrame:
    """Confusion counts (by..., cand, y, pred, n) of every candidate.

    ``merge_equal`` first merges rows with the same probabilities and label, worthwhile when they
    come from lookups and take few values.
    """
    keep = df.select(*by, F.col(label).alias("y"), *ps)
    n = F.lit(1)
    if merge_equal:
        keep = keep.groupBy(*by, "y", *ps).agg(F.count(F.lit(1)).alias("__m"))
        n = F.col("__m")
    spread = keep.withColumn("__c", F.explode(candidate_array(candidates)))
    ws = [F.col(f"__c.w{k}") for k in range(len(ps))]
    pred = P.argmax(P.weighted(ps, ws))
    rows = spread.select(*by, F.col("__c.cand").alias("cand"), "y", pred.alias("pred"), n.alias("m"))
    return rows.groupBy(*by, "cand", "y", "pred").agg(F.sum("m").alias("n"))


def candidate_scores(counts: DataFrame, fold: str, k_folds: int, mode: str) -> DataFrame:
    """(outer_fold, cand, balanced_accuracy) from the folds' training or held-out parts."""
    outer = F.explode(F.sequence(F.lit(0), F.lit(k_folds - 1)))
    pairs = counts.withColumn("outer_fold", outer)
    same = F.col(fold) == F.col("outer_fold")
    pairs = pairs.where(same if mode == "valid" else ~same)
    merged = pairs.groupBy("outer_fold", "cand", "y", "pred").agg(F.sum("n").alias("n"))
    return balanced_accuracy(merged, ["outer_fold", "cand"])


def best_per_fold(scores: DataFrame) -> DataFrame:
    """Best candidate per fold; the lowest candidate number wins ties (scores rounded to 1e-9)."""
    order = F.struct(F.round("balanced_accuracy", 9), -F.col("cand"))
    return scores.groupBy("outer_fold").agg(
        F.max_by("cand", order).alias("cand"), F.max("balanced_accuracy").alias("balanced_accuracy")
    )


class ClassWeights:
    """Fitted weights; ``predict`` is the weighted argmax, ``predict_proba`` the renormalised rows."""

    def __init__(self, weights: list[float], per_fold: list[list[float]] | None = None):
        self.weights = [float(w) for w in weights]
        self.per_fold = per_fold or [self.weights]

    def predict(self, ps) -> Column:
        return P.argmax(P.weighted(ps, self.weights))

    def predict_proba(self, ps) -> list[Column]:
        return P.renormalize(P.weighted(ps, self.weights))


def fit_class_weights(
    df: DataFrame,
    label: str,
    ps: list[str],
    key: str = "id",
    k_folds: int = 5,
    mode: str = "train",
    seed=42,
    refinements: int = 2,
    grid: str = "full",
) -> ClassWeights:
    """Mean over folds of the best weights of each fold; ``k_folds <= 1`` fits once on all rows.

    Every fold chooses among the candidates around the best of all folds. ``grid`` "full" varies all classes together (up to six
    classes, ValueError beyond), "axis" one class at a time, repeated by the refinements; the caller chooses.
    """
    if mode not in ("train", "valid"):
        raise ValueError("mode is 'train' or 'valid'")
    if grid not in ("full", "axis"):
        raise ValueError("grid is 'full' or 'axis'")
    k = len(ps)
    single = not k_folds or k_folds <= 1
    if single:
        data, k_folds, mode = df.select(label, *ps).withColumn("__f", F.lit(0)), 1, "valid"
    else:
        data = plain_folds(df.select(key, label, *ps), key, k_folds, seed, "__f")
    data = data.persist()
    try:
        centers, half, unit = [[1.0] * k], 4, 1.0
        for step in range(refinements + 1):
            if step:
                centers = [c for i, c in enumerate(chosen) if c not in chosen[:i]]
                half, unit = 3, unit / 4.0
            if grid == "full":
                scores = grid_scores(data, label, ps, "__f", k_folds, mode, half, unit, centers)
                weights = lambda i: grid_weights(i, centers, half, unit)
            else:
                listed = [w for c in centers for w in axis_grid(k, half, unit, c)]
                counts = score_candidates(data, label, ps, listed, ["__f"])
                scores = candidate_scores(counts, "__f", k_folds, mode)
                weights = listed.__getitem__
            best = {r["outer_fold"]: r["cand"] for r in best_per_fold(scores).collect()}  # k_folds rows
            if len(best) < k_folds:
                raise ValueError("a fold without rows has no best weights")
            chosen = [weights(best[j]) for j in range(k_folds)]
    finally:
        data.unpersist()
    mean = [sum(w[i] for w in chosen) / k_folds for i in range(k)]
    return ClassWeights(mean, chosen)


__all__ = [
    "ClassWeights",
    "axis_grid",
    "best_per_fold",
    "candidate_scores",
    "confusion",
    "fit_class_weights",
    "grid_scores",
    "grid_weights",
    "log_grid",
    "score_candidates",
]
