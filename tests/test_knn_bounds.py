"""Blocks of the k-NN join: candidates by a matrix product, distances and order as element by element."""

import numpy as np
import pytest

from tabstrata.learners import knn


def _plain(q, t, qg, tg, key, k, p):
    d = knn._distances(q, t, p)
    d[qg[:, None] == tg[None, :]] = np.inf
    out = []
    for i in range(len(q)):
        order = sorted(np.flatnonzero(np.isfinite(d[i])), key=lambda c: (d[i, c], key[c]))[:k]
        out += [(i, c, d[i, c]) for c in order]
    return out


@pytest.mark.parametrize("shift", [0.0, 1e6, -1e9])
@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("grid", [None, 3])
def test_blocks_match_all_pairs_bit_by_bit(shift, p, grid):
    rng = np.random.default_rng(5)
    t, q = rng.normal(size=(700, 8)), rng.normal(size=(300, 8))
    if grid:  # many ties
        t, q = np.round(t * grid) / grid, np.round(q * grid) / grid
    q[:50] = t[:50]
    t, q = t + shift, q + shift
    key, qg, tg = rng.permutation(700), rng.integers(0, 5, 300), rng.integers(0, 5, 700)
    found = list(zip(*knn._nearest(q, t, qg, tg, key, 5, p)))
    assert found == _plain(q, t, qg, tg, key, 5, p)


def test_squares_beyond_doubles_and_few_rows():
    t, q = np.array([[1e160, 0.0], [2e160, 0.0], [3.0, 0.0]]), np.array([[0.0, 0.0]])
    for rows in (t, t[:2], t[:0]):
        args = (q, rows, np.zeros(1), np.ones(len(rows)), np.arange(len(rows)), 2, 2)
        assert list(zip(*knn._nearest(*args))) == _plain(*args)


def test_euclidean_blocks_do_not_walk_the_columns(monkeypatch):
    monkeypatch.setattr(knn, "_distances", lambda *a: pytest.fail("all pairs, column by column"))
    rng = np.random.default_rng(1)
    knn._nearest(rng.normal(size=(40, 64)), rng.normal(size=(90, 64)), np.zeros(40), np.ones(90), np.arange(90), 5, 2)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("levels", [1, 6])
def test_balls_reach_the_cells_whose_boxes_they_touch(p, levels):
    rng = np.random.default_rng(3)
    t, q = rng.normal(size=(400, 3)) ** 3, rng.normal(size=(90, 3))
    cells = knn.Cells(t[:150], levels)
    at = cells.assign(t)
    ids = np.unique(at)[1:]  # a cell without points
    low, high = (np.array([f(t[at == c], axis=0) for c in ids]) for f in (np.min, np.max))
    limit = np.abs(rng.normal(size=90))
    limit[:5] = np.inf
    gap = np.maximum(np.maximum(low - q[:, None], q[:, None] - high), 0.0)
    d = gap.sum(axis=2) if p == 1 else np.sqrt((gap**2).sum(axis=2))
    found = list(zip(*cells.boxes(ids, low, high).reached(q, limit, p)))
    assert found == [(r, ids[c]) for r, c in zip(*np.nonzero(d <= limit[:, None]))]


def test_far_cells_are_not_looked_at_one_by_one():
    """A query asks the boxes on its way, not those of all cells; more cells keep their size."""
    rng = np.random.default_rng(4)
    t = rng.random((40_000, 2))
    cells = knn.Cells(t, 12)
    at = cells.assign(t)
    ids = np.unique(at)
    low, high = (np.array([f(t[at == c], axis=0) for c in ids]) for f in (np.min, np.max))
    boxes, asked = cells.boxes(ids, low, high), []

    class Counted(np.ndarray):
        def __getitem__(self, i):
            if not isinstance(i, tuple):
                asked.append(len(i))
            return np.asarray(self)[i]

    boxes.low = boxes.low.view(Counted)
    rows, _ = boxes.reached(t[:500], np.full(500, 0.01), 2)
    assert 500 <= len(rows) and sum(asked) < 500 * len(ids) / 10
    assert knn.MAX_CELLS >= 60_000


def test_searches_of_few_rows_take_few_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.range(3_000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 3).alias("y"))
    tasks, real = [], knn._search
    monkeypatch.setattr(knn, "_search", lambda asked, points, *a: tasks.append(points.rdd.getNumPartitions()) or real(asked, points, *a))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near = knn.knn_join(df.persist(), df, "id", ["a", "b"], "y", 3, 2, cell_rows=100).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks == [spark.sparkContext.defaultParallelism] * 2
    x = df.toPandas()
    d = np.sqrt((x.a.to_numpy()[:, None] - x.a.to_numpy()) ** 2 + (x.b.to_numpy()[:, None] - x.b.to_numpy()) ** 2)
    expected = np.sort(d, axis=1)[:, :3]
    found = near.sort_values(["id", "rank"])["distance"].to_numpy().reshape(-1, 3)
    np.testing.assert_allclose(found, expected, atol=1e-12)
