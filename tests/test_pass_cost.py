"""Passes over training rows: few tasks for few rows, packed sums merged by block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.functions.hashing import unit_hash
from tabstrata.learners import boosting as BO
from tabstrata.learners.base import BLOCK_STRIPS, ROWS, STRIP, blocks, partial_sums, rows_of
from tabstrata.plans.fixtures import training_frame
from tabstrata.runtime import ROWS_PER_TASK, fewer_tasks


def test_few_rows_make_few_tasks(spark, small):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = training_frame(spark, small, seed=77)
        assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert df.count() == training_frame(spark, small).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    many = spark.range(0, 1000, 1, 64)
    assert fewer_tasks(many, 1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert fewer_tasks(many, 64 * ROWS_PER_TASK).rdd.getNumPartitions() == 64


@pytest.mark.parametrize("length", [1, 3 * STRIP + 1, 2 * BLOCK_STRIPS * STRIP + 5])
def test_sums_over_blocks_keep_their_bits(spark, length):
    df = spark.range(0, 200, 1, 7).withColumn("x", F.rand(3) * F.pow(F.lit(10.0), F.col("id") % 12)).persist()

    def add(pdf, acc):
        np.add.at(acc, pdf["id"].to_numpy() * 7919 % length, pdf["x"].to_numpy())

    first = partial_sums(df, ["id", "x"], add, length)
    expected = np.zeros(length)
    add(df.toPandas(), expected)
    np.testing.assert_allclose(first, expected, rtol=1e-12)
    for _ in range(3):
        assert partial_sums(df, ["id", "x"], add, length).tobytes() == first.tobytes()


def test_blocks_hold_all_rows(spark):
    df = spark.range(0, 25_000, 1, 3).withColumn("x", F.col("id") * 0.5)
    packed = blocks(df, ["x", "id"])
    assert packed.columns == [ROWS] and packed.count() < 10
    seen = [b for batch in packed.toArrow().to_batches() for b in rows_of(batch)]
    assert sorted(np.concatenate([b.column(1).to_numpy() for b in seen])) == list(range(25_000))

    def add(pdf, acc):
        acc[0] += len(pdf)
        acc[1] += pdf["x"].sum()

    for frame in (df, packed):
        assert partial_sums(frame, ["x"], add, 2).tolist() == [25_000, 0.5 * 25_000 * 24_999 / 2]


@pytest.mark.parametrize("spec", [BO.DEPTHWISE, BO.LEAFWISE, BO.SYMMETRIC], ids=["depth", "leaf", "symmetric"])
def test_boosting_passes_move_blocks_and_deal_rows_to_their_nodes(spark, monkeypatch, spec):
    n = 20_000
    df = spark.range(0, n, 1, 4).select(
        "id", *[unit_hash(f"f{i}", "id").alias(f"f{i}") for i in range(3)], (F.col("id") % 3).cast("int").alias("y")
    ).persist()
    df = df.withColumn("f0", F.col("f0") + 0.3 * F.col("y")).withColumn("fold", (F.col("id") % 2).cast("int"))
    handed, sums = [], []
    real = BO.partial_sums

    def counted(frame, *args):
        handed.append(frame.count())
        return real(frame, *args)

    histograms = BO.HistogramBooster._histograms

    def kept(self, state, b, round_, trees, asked):
        out = histograms(self, state, b, round_, trees, asked)
        sums.append((list(asked), out[0]))
        return out

    monkeypatch.setattr(BO, "partial_sums", counted)
    monkeypatch.setattr(BO.HistogramBooster, "_histograms", kept)
    small = BO.replace(spec, rounds=2, max_depth=3, max_leaves=5 if spec.max_leaves else None, early_stopping=None)
    models = BO.HistogramBooster(3, small, ["f0", "f1", "f2"]).fit_folds(df, "y", "fold", 2)
    assert handed and max(handed) <= 4 * 2  # blocks, of some thousand rows each
    # every feature's bins hold each row of a node once, and a root holds the rows its model trains on
    for asked, h in sums:
        rows = h[..., 2].sum(axis=2)
        assert (rows == rows[:, :1]).all()
        for (i, _, node), r in zip(asked, rows):
            assert r[0] == (n if i == 2 else n / 2) if node == 0 else 0 <= r[0] < n  # symmetric splits may leave a node empty
    # leaves reached by splits are those reached row by row
    x = np.random.default_rng(5).random((2_000, 3))
    bins = models[-1].binner.pack(*x.T)
    for tree in [t for m in models for per in m.trees for t in per]:
        route, found = tree.route(), np.full(len(x), -1)
        for leaf, rows in zip(route.wanted, route.rows(list(np.ascontiguousarray(bins.T)), np.arange(len(x)))):
            found[rows] = leaf
        assert (found == tree.nodes(bins)).all()


def test_logistic_passes_move_blocks(spark, monkeypatch):
    from tabstrata.learners import linear as LI

    df = spark.range(0, 5_000, 1, 2).select(unit_hash("a", "id").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    handed, real = [], LI.partial_sums
    monkeypatch.setattr(LI, "partial_sums", lambda frame, *a: handed.append(frame.count()) or real(frame, *a))
    LI.ElasticNetLogistic(2).fit(df, ["a"], "y")
    assert handed and max(handed) <= 2


def test_linear_svc_passes_move_blocks(spark, monkeypatch):
    from tabstrata.learners import linear as LI

    df = spark.range(0, 5_000, 1, 2).select(unit_hash("a", "id").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    handed, real = [], LI.partial_sums
    monkeypatch.setattr(LI, "partial_sums", lambda frame, *a: handed.append(frame.count()) or real(frame, *a))
    LI.SquaredHingeSVC(2).fit(df, ["a"], "y")
    assert handed and max(handed) <= 2


@pytest.mark.parametrize("bootstrap", [False, True])
def test_forest_passes_move_large_blocks(spark, monkeypatch, bootstrap):
    from tabstrata.learners import forests as FO

    n = 30_000
    df = spark.range(0, n, 1, 2).select("id", *[unit_hash(f"f{i}", "id").alias(f"f{i}") for i in range(3)], (F.col("id") % 3).cast("int").alias("y"))
    df = df.withColumn("f0", F.col("f0") + 0.3 * F.col("y")).withColumn("fold", (F.col("id") % 2).cast("int"))
    handed, sums, real = [], [], FO.partial_sums
    monkeypatch.setattr(FO, "partial_sums", lambda frame, *a: handed.append(frame.count()) or real(frame, *a))
    histograms = FO.Forest._histograms

    def kept(self, state, held, trees, asked, *args):
        out = histograms(self, state, held, trees, asked, *args)
        sums.append((list(asked), out))
        return out

    monkeypatch.setattr(FO.Forest, "_histograms", kept)
    FO.Forest(3, 3, 3, 20, 2, bootstrap=bootstrap).fit_folds(df, ["f0", "f1", "f2"], "y", "fold", 2)
    assert handed and max(handed) <= 2  # a block for each partition
    for asked, h in sums:
        rows, drawn = h[..., -1].sum(2), h[..., :-1].sum((2, 3))
        assert (rows == rows[:, :1]).all() and (drawn == drawn[:, :1]).all()
        for (i, _, node, *_), r, w in zip(asked, rows[:, 0], drawn[:, 0]):
            if not bootstrap:
                assert r == w and (node or r == (n if i == 2 else n / 2))
            elif not node:
                assert abs(r / w - 0.632) < 0.02


def test_leaves_of_a_tree_of_bins():
    from tabstrata.learners.base import leaves

    rng, feature, child = np.random.default_rng(3), np.array([1, 0, -1, -1, -1]), np.array([1, 3, 0, 0, 0])
    right, bins = rng.random((5, 256)) < 0.5, rng.integers(0, 256, (500, 2)).astype(np.uint8)
    want = []
    for row in bins:
        n = 0
        while feature[n] >= 0:
            n = child[n] + right[n, row[feature[n]]]
        want.append(n)
    assert leaves(feature, child, right, bins).tolist() == want
    assert leaves(np.array([-1]), np.array([0]), right[:1], bins).tolist() == [0] * 500
