"""A k-NN search carries a bound for each query, and what it caches is released when its votes are written."""

import numpy as np
from pyspark.sql import functions as F

from tabstrata.learners import knn


def test_votes_leave_nothing_cached_and_searches_return_bounds_first(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 3)) + [3, 1, 0]
    df = spark.createDataFrame([(i, *map(float, r), i % 3) for i, r in enumerate(x)], "id long, a double, b double, c double, y int")
    model = knn.SvdKnn(3, 2, 4).fit(df, ["a", "b", "c"], "y")
    asked = df.where("id % 5 = 0").union(spark.createDataFrame([(9_000, 80.0, -70.0, 5.0, 0)], df.schema))
    join, search, columns = knn.knn_join, knn._search, []
    monkeypatch.setattr(knn, "knn_join", lambda *a, **kw: join(*a, **kw, cell_rows=20))

    def seen(*args):
        out = search(*args)
        columns.append(out.columns)
        return out

    monkeypatch.setattr(knn, "_search", seen)
    persistent = spark.sparkContext._jsc.getPersistentRDDs
    start = set(persistent())
    got = model.score(asked, "p").orderBy("id").toPandas()
    assert not set(persistent()) - start
    assert "neighbour" not in columns[0] and "bound" in columns[0] and "neighbour" in columns[1]
    names = model.svd.names
    t = model.train.orderBy("id").toPandas()
    q = model.scaler.transform(model.svd.transform(asked)).orderBy("id").select(*names).toPandas().to_numpy()
    d = np.sqrt(((q[:, None] - t[names].to_numpy()[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    want = np.stack([(t.y.to_numpy()[near] == c).mean(axis=1) for c in range(3)], axis=1)
    np.testing.assert_allclose(got[["p_0", "p_1", "p_2"]].to_numpy(), want)


def test_queries_whose_cell_holds_no_points_are_searched(spark):
    train = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(10.0).alias("a"), (F.col("id") * 1.0).alias("b"), F.lit(0).alias("y"))
    asked = spark.createDataFrame([(1, 5.0, 1e6), (2, 5.0, -1e6), (3, 10.0, 77.0)], "id long, a double, b double")
    got = knn.knn_join(asked, train, "id", ["a", "b"], "y", 2, cell_rows=10).orderBy("id", "rank").toPandas()
    assert got["id"].tolist() == [1, 1, 2, 2, 3, 3] and got["neighbour"].tolist() == [199, 198, 0, 1, 77, 75]
