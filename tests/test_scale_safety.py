"""The ways that keep large or skewed inputs out of one task give the same results as the short ways."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabstrata.functions.hashing import seeded_md5
from tabstrata.learners.knn import knn_join, vote
from tabstrata.operators import folds as FO
from tabstrata.operators import profile as PR
from tabstrata.operators.isotonic import IsotonicMaps, isotonic_blocks
from tabstrata.operators.quantiles import quantiles
from tabstrata.runtime import lookup_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one key; a few outliers; some nulls."""
    i = F.col("id")
    return spark.range(6_000).select(
        i,
        F.when(i % 3 == 0, 7.0).when(i % 997 == 0, 1e9).when(i % 11 == 0, None).otherwise((i * i) % 1013 / 7.0).alias("x"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (i % 50).cast("string"))).alias("key"),
        (i % 2).alias("g"),
    )


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_narrowing_is_exact(skewed, by):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    short = quantiles(skewed, ["x"], probs, by)
    long = quantiles(skewed, ["x"], probs, by, exact_limit=20, bins=8)
    assert short.keys() == long.keys()
    for key in short:
        assert long[key]["x"] == pytest.approx(short[key]["x"], rel=1e-12)


def test_box_and_summary_beyond_the_limit(skewed):
    assert PR.box_stats(skewed, "x", exact_limit=10).first() == PR.box_stats(skewed, "x").first()
    a = PR.numeric_summary(skewed, ["x"], exact_limit=10).first()
    assert a["median"] == PR.numeric_summary(skewed, ["x"]).first()["median"]


def test_folds_equal_the_single_window(spark, train):
    df = train.select("id", "class_encoded")
    w = Window.partitionBy("class_encoded").orderBy(seeded_md5(42, "id"), "id")
    want = df.withColumn("want", ((F.row_number().over(w) - 1) % 5).cast("int"))
    got = FO.stratified_folds(df.repartition(13), k=5)
    both = got.join(want.select("id", "want"), "id")
    assert both.where("fold <> want").count() == 0 and both.count() == df.count()


def test_null_stratum_keeps_rows(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(40)], "id long, y string")
    got = FO.stratified_folds(df, "id", "y", 4).groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in got) == 40
    assert {r["count"] for r in got if r["y"] is None} <= {6, 7}


def test_lookup_join_salted_keeps_every_row(spark, skewed):
    table = skewed.select("key").distinct().where("key <> 'k7'").withColumn("v", F.length("key"))
    short = lookup_join(skewed, table, ["key"])
    long = lookup_join(skewed, table, ["key"], limit=3, salts=4)
    assert long.columns == short.columns
    assert long.count() == skewed.count()
    assert long.exceptAll(short).count() == 0


def test_histogram_covers_all_rows(skewed):
    h = PR.histogram(skewed, "x", 12).collect()
    assert len(h) == 12
    assert sum(r["n"] for r in h) == skewed.where("x is not null").count()


def test_density_of_a_null_free_column(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("x"))
    got = {r["point"]: r["density"] for r in PR.kernel_density(df, "x", 50, cut=3.0).collect()}
    x = np.array([i % 37 for i in range(500)], dtype=float)
    h = x.std(ddof=1) * 500**-0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 50)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (500 * h * np.sqrt(2 * np.pi))
    assert [got[i] for i in range(50)] == pytest.approx(want.tolist(), rel=1e-9)


# nearest neighbours ---------------------------------------------------------------------------------
def _brute(points, k, p, grouped):
    out = {}
    for i, x, g, _ in points:
        d = []
        for j, z, h, label in points:
            if grouped and g == h:
                continue
            gap = np.abs(np.array(x) - np.array(z))
            d.append((float(gap.sum() if p == 1 else np.sqrt((gap**2).sum())), j, label))
        out[i] = [(j, label) for _, j, label in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("grouped", [True, False])
def test_knn_equals_brute_force(spark, p, grouped):
    rng = np.random.default_rng(3)
    points = []
    for i in range(240):
        x = [5.0, 5.0, 5.0] if i % 3 == 0 else rng.integers(0, 12, 3).astype(float).tolist()
        points.append((i, x, i % 4, i % 5))
    df = spark.createDataFrame(
        [(i, *x, g, y) for i, x, g, y in points], "id long, a double, b double, c double, fold int, y int"
    )
    got = knn_join(df, df, "id", ["a", "b", "c"], "y", 6, p, "fold" if grouped else None, cell_rows=20)
    found: dict = {}
    for r in got.orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["neighbour"], r["y"]))
    assert found == _brute(points, 6, p, grouped)


def test_distance_vote(spark):
    rows = [(1, 10, 0.0, 2), (1, 11, 1.0, 0), (2, 10, 1.0, 0), (2, 11, 3.0, 1)]
    df = spark.createDataFrame(rows, "id long, neighbour long, distance double, y int")
    got = {r["id"]: list(r)[1:] for r in vote(df, "id", "y", 3, "distance", "p").collect()}
    assert got[1] == [0.0, 0.0, 1.0]
    assert got[2] == pytest.approx([0.75, 0.25, 0.0])


# isotonic -------------------------------------------------------------------------------------------
def test_isotonic_matches_max_min(spark):
    rng = np.random.default_rng(0)
    rows = [(f, float(s), int(rng.random() < s / 40)) for f in (0, 1) for s in rng.integers(0, 40, 300)]
    df = spark.createDataFrame(rows, "f int, s double, t int").repartition(7)
    blocks = isotonic_blocks(df, ["f"], "s", "t").collect()
    for f in (0, 1):
        xs = sorted({s for g, s, _ in rows if g == f})
        total = {x: [t for g, s, t in rows if g == f and s == x] for x in xs}
        prefix = np.concatenate([[0], np.cumsum([sum(total[x]) for x in xs])])
        count = np.concatenate([[0], np.cumsum([len(total[x]) for x in xs])])
        mean = [[(prefix[j + 1] - prefix[i]) / (count[j + 1] - count[i]) if j >= i else np.inf for j in range(len(xs))] for i in range(len(xs))]
        want = [max(min(mean[i][j] for j in range(b, len(xs))) for i in range(b + 1)) for b in range(len(xs))]
        got = [next(r["value"] for r in blocks if r["f"] == f and r["lo"] <= x <= r["hi"]) for x in xs]
        assert got == pytest.approx(want)


def test_isotonic_interpolates_and_clips(spark):
    df = spark.createDataFrame([(0, 0.0, 0), (0, 1.0, 0), (0, 3.0, 1)], "f int, s double, t int")
    maps = IsotonicMaps.fit(df, ["f"], "s", "t")
    assert maps.apply((0,), np.array([-5.0, 0.5, 2.0, 9.0])).tolist() == [0.0, 0.0, 0.5, 1.0]
