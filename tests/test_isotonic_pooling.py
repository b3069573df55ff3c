"""Isotonic pooling of whole stretches: the blocks of pooling one score after the other, in linear time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.operators import isotonic as IS


def _one_by_one(score, total, n):
    stack = []
    for s, t, w in zip(score.tolist(), total.tolist(), n.tolist()):
        IS._pool(stack, s, s, t, w)
    return [np.array(x, dtype=float) for x in zip(*stack)]


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "ties", "saw"])
def test_stretches_pool_as_scores_do_one_by_one(kind):
    rng = np.random.default_rng(9)
    m = 20_000
    n = rng.integers(1, 4, m).astype(float)
    share = {"noise": rng.random(m), "falling": np.linspace(1, 0, m), "rising": np.linspace(0, 1, m), "ties": np.full(m, 0.5)}
    share["saw"] = np.linspace(0, 1, m) + np.where(np.arange(m) % 1_000 == 999, -0.4, 0.0)
    total = np.round(n * share[kind] * 8)
    score = np.arange(m) / 7.0
    for found, expected in zip(IS.pooled(score, score, total, n), _one_by_one(score, total, n)):
        assert (found == expected).all()


def test_adverse_stretches_stay_linear():
    m = 200_000  # each block swallows one more score a round
    total, n = np.arange(m)[::-1] % 3 + np.r_[0.0, np.arange(1, m)] * 1e-6, np.ones(m)
    start = time.perf_counter()
    found = IS.pooled(n.cumsum(), n.cumsum(), total, n)
    assert time.perf_counter() - start < 5 and found[3].sum() == m


def test_blocks_of_two_groups(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 2).cast("int").alias("g"), F.rand(4).alias("s"), (F.rand(5) < 0.3).cast("int").alias("t")
    ).persist()
    out = IS.isotonic_blocks(df, ["g"], "s", "t").toPandas()
    rows = df.toPandas().sort_values(["g", "s"])
    for g, part in rows.groupby("g"):
        expected = _one_by_one(part["s"].to_numpy(), part["t"].to_numpy().astype(float), np.ones(len(part)))
        found = out[out["g"] == g].sort_values("lo")
        assert (found["lo"].to_numpy() == expected[0]).all() and (found["n"].to_numpy() == expected[3]).all()
