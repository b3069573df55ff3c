"""Leaf-wise growth against splitting one leaf at a time."""

from dataclasses import replace

import numpy as np
import pytest

from tabstrata.learners import boosting as BO

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(900, 3)), 2)
    y = ((x[:, 0] * x[:, 1] > 0.1).astype(int) + (x[:, 2] > 0.8)).astype(int)
    data = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int").repartition(3).persist(), x, y


def brute_force(learner, binner, base, x, y, cls, max_leaves):
    """(leaf value of each row, number of leaves) of one tree, one split after the other."""
    spec, bins = learner.spec, binner.pack(*x.T).astype(int)
    p = np.exp(base) / np.exp(base).sum()
    g = p[cls] - (y == cls)
    h = np.full(len(y), 2 * p[cls] * (1 - p[cls]))

    def sums(rows):
        out = np.zeros((3, spec.max_bins, 3))
        for f in range(3):
            for s, v in enumerate((g, h, np.ones(len(y)))):
                out[f, :, s] = np.bincount(bins[rows, f], v[rows], spec.max_bins)
        return out

    leaves = [(np.arange(len(y)), 0, 0)]
    offered = np.ones(3, bool)
    while len(leaves) < max_leaves:
        options = []
        for at, (rows, depth, heap) in enumerate(leaves):
            found = learner._best_split(sums(rows)[None], offered, None) if depth < spec.max_depth else None
            if found:
                options.append((found[0], -heap, at, found[1], found[2]))
        if not options:
            break
        _, _, at, f, left = max(options, key=lambda o: o[:2])
        rows, depth, heap = leaves.pop(at)
        goes = left[bins[rows, f]]
        leaves += [(rows[goes], depth + 1, 2 * heap + 1), (rows[~goes], depth + 1, 2 * heap + 2)]
    value = np.zeros(len(y))
    for rows, _, _ in leaves:
        value[rows] = learner._leaf(np.array([g[rows].sum(), h[rows].sum(), len(rows)]))
    return value, len(leaves)


@pytest.mark.parametrize("max_leaves,max_depth", [(2, 9), (7, 9), (16, 4), (31, 30), (12, 2)])
def test_equals_one_leaf_at_a_time(rows, max_leaves, max_depth, monkeypatch):
    df, x, y = rows
    looked = []
    whole = BO.LeafTree.compact

    def compact(self):
        looked.append(self.looked)
        return whole(self)

    monkeypatch.setattr(BO.LeafTree, "compact", compact)
    spec = replace(BO.LEAFWISE, rounds=1, max_leaves=max_leaves, max_depth=max_depth, min_child_rows=10.0, max_bins=32)
    learner = BO.HistogramBooster(3, spec, COLUMNS)
    model = learner.fit(df, "y")
    bins = model.binner.pack(*x.T)
    for c in range(3):
        want, leaves = brute_force(learner, model.binner, model.base, x, y, c, max_leaves)
        tree = model.trees[0][c]
        assert (tree.feature < 0).sum() == leaves <= max_leaves
        assert np.allclose(tree.predict(bins), want, atol=1e-9)
    assert max(looked) <= 2 * max_leaves
