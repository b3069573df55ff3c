"""Class weights from cell counts against scoring every row under every candidate."""

import numpy as np
import pytest

from tabstrata.operators import class_weights as CW
from tabstrata.operators.weight_cells import MAX_CELLS, grid_scores, grid_size, grid_weights


def brute(rows, k, weights, k_folds, mode):
    """{(fold, cand): balanced accuracy}; rows are (fold, y, probabilities)."""
    f = np.array([r[0] for r in rows])
    y = np.array([-1 if r[1] is None else r[1] for r in rows])
    p = np.array([r[2] for r in rows])
    out = {}
    for cand, w in enumerate(weights):
        pred = np.argmax(p * np.array(w), axis=1)
        for j in range(k_folds):
            use = f == j if mode == "valid" else f != j
            recalls = [np.mean(pred[use & (y == c)] == c) for c in np.unique(y[use])]
            if recalls:
                out[j, cand] = np.mean(recalls)
    return out


def frame(spark, rows, k):
    flat = [(f, y, *[float(v) for v in p]) for f, y, p in rows]
    return spark.createDataFrame(flat, "fold int, y int, " + ", ".join(f"p_{c} double" for c in range(k)))


def draw(seed, n, k, k_folds, coarse):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        p = rng.integers(0, 9, k) / 8.0 if coarse else rng.dirichlet(np.ones(k))
        rows.append((int(rng.integers(k_folds)), int(rng.integers(k)), p.tolist()))
    return rows


@pytest.mark.parametrize("k,half,mode,coarse", [(2, 4, "train", True), (3, 4, "train", False), (3, 2, "valid", True), (4, 2, "train", True)])
def test_same_scores_as_exploding_rows(spark, k, half, mode, coarse):
    """Coarse probabilities are full of ties and zeros; centers are powers of two, so that ties stay ties."""
    rows = draw(k, 400, k, 3, coarse)
    centers = [[1.0] * k, [1.0] + [2.0**c for c in range(1, k)]]
    weights = [grid_weights(i, centers, half, 1.0) for i in range(2 * grid_size(k, half))]
    df = frame(spark, rows, k)
    ps = [f"p_{c}" for c in range(k)]
    scores = grid_scores(df, "y", ps, "fold", 3, mode, half, 1.0, centers)
    got = {(r["outer_fold"], r["cand"]): r["balanced_accuracy"] for r in scores.collect()}
    want = brute(rows, k, weights, 3, mode)
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-12
    if k < 4:
        listed = CW.candidate_scores(CW.score_candidates(df, "y", ps, weights, ["fold"]), "fold", 3, mode)
        slow = {(r["outer_fold"], r["cand"]): r["balanced_accuracy"] for r in listed.collect()}
        assert slow.keys() == got.keys() and max(abs(got[i] - slow[i]) for i in slow) < 1e-12


def test_fine_grids_around_any_center(spark):
    rows = draw(9, 300, 3, 2, False)
    centers = [[1.0, 0.37, 1.9], [1.0, 2.2, 0.3]]
    weights = [grid_weights(i, centers, 3, 0.25) for i in range(2 * 49)]
    scores = grid_scores(frame(spark, rows, 3), "y", ["p_0", "p_1", "p_2"], "fold", 2, "train", 3, 0.25, centers)
    want = brute(rows, 3, weights, 2, "train")
    got = {(r["outer_fold"], r["cand"]): r["balanced_accuracy"] for r in scores.collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-12


@pytest.mark.parametrize("k", [5, 6])
def test_full_grids_of_many_classes(spark, k):
    rows = draw(k, 300, k, 2, True)
    df = frame(spark, rows, k)
    scores = grid_scores(df, "y", [f"p_{c}" for c in range(k)], "fold", 2, "train").cache()
    assert scores.count() == 2 * 9 ** (k - 1)
    some = np.random.default_rng(0).integers(0, 9 ** (k - 1), 50).tolist()
    weights = {i: grid_weights(i, [[1.0] * k], 4, 1.0) for i in some}
    got = {(r["outer_fold"], r["cand"]): r["balanced_accuracy"] for r in scores.where(scores.cand.isin(some)).collect()}
    for i, w in weights.items():
        for (j, _), v in brute(rows, k, [w], 2, "train").items():
            assert abs(got[j, i] - v) < 1e-12
    scores.unpersist()


def test_more_classes_need_the_axis_grid(spark):
    k = 8
    rows = draw(1, 200, k, 1, False)
    df = frame(spark, [(0, y, (0.05 * np.array(p) + (0.02 if y else 0.9) * np.eye(k)[y] + 0.4 * np.eye(k)[0]).tolist()) for _, y, p in rows], k)
    ps = [f"p_{c}" for c in range(k)]
    assert (4 * 4 + 2) ** (k - 1) > MAX_CELLS
    with pytest.raises(ValueError, match="one class at a time"):
        grid_scores(df, "y", ps, "fold", 1, "valid")
    fit = CW.fit_class_weights(df, "y", ps, k_folds=1, grid="axis")
    assert len(fit.weights) == k and min(fit.weights) > 0
    with pytest.raises(ValueError, match="full"):
        CW.fit_class_weights(df, "y", ps, grid="some")


def test_nulls_and_empty_tables(spark):
    """A null label is never right; a null probability never wins; no rows give no scores."""
    df = spark.createDataFrame(
        [(0, 0, None, 0.2), (0, 0, 0.9, None), (0, 1, 0.5, 0.5), (0, None, 0.5, 0.5), (0, 1, None, 0.1), (0, 1, float("nan"), 0.9)],
        "fold int, y int, p_0 double, p_1 double",
    )
    listed = [grid_weights(i, [[1.0, 1.0]], 4, 1.0) for i in range(9)]
    want = CW.candidate_scores(CW.score_candidates(df, "y", ["p_0", "p_1"], listed, ["fold"]), "fold", 1, "valid").collect()
    got = grid_scores(df, "y", ["p_0", "p_1"], None, 1, "valid").collect()
    assert {(r["cand"], round(r["balanced_accuracy"], 12)) for r in got} == {(r["cand"], round(r["balanced_accuracy"], 12)) for r in want}
    assert grid_scores(df.limit(0), "y", ["p_0", "p_1"], "fold", 2, "train").count() == 0
