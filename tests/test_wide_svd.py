"""Singular vectors of wide tables against the Gram matrix and numpy."""

import numpy as np
import pandas as pd
import pytest

from tabstrata.operators.scale import TruncatedSVD
from tabstrata.operators.wide_svd import leading_vectors, triangular_factor


def wide_frame(spark, x):
    columns = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame(x, columns=columns)).repartition(4).persist(), columns


def gap(u, v):
    """Sine of the largest angle between two subspaces."""
    return np.linalg.norm(u - v @ (v.T @ u), 2)


def test_two_thousand_columns(spark):
    """The subspace of the Gram way, within 1e-6, for a spectrum that falls slowly."""
    rng = np.random.default_rng(1)
    d, rank = 2000, 60
    x = rng.standard_normal((400, rank)) * np.linspace(3.0, 1.0, rank) @ np.linalg.qr(rng.standard_normal((d, rank)))[0].T
    x += 0.01 * rng.standard_normal((400, d))
    df, columns = wide_frame(spark, x)
    v, s = leading_vectors(df, columns, 5)
    values, vectors = np.linalg.eigh(x.T @ x)
    assert gap(v, vectors[:, ::-1][:, :5]) < 1e-6
    assert np.allclose(s, np.sqrt(values[::-1][:5]), rtol=1e-9)
    df.unpersist()


def test_small_singular_values_are_not_squared_away(spark):
    """A singular value 1e-9 of the first is lost in a Gram matrix of doubles; the triangular factor keeps it."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.standard_normal((300, 4)))[0], np.linalg.qr(rng.standard_normal((6, 4)))[0]
    x = u * np.array([1.0, 1e-3, 1e-6, 1e-9]) @ v.T
    df, columns = wide_frame(spark, x)
    s = np.linalg.svd(triangular_factor(df, columns, v), compute_uv=False)
    assert np.allclose(s, [1.0, 1e-3, 1e-6, 1e-9], rtol=1e-5)
    df.unpersist()


def test_both_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 12)) * np.linspace(4.0, 1.0, 12)
    df, columns = wide_frame(spark, x)
    gram = TruncatedSVD(columns, 3).fit(df)
    rows = gram.transform(df).orderBy("c0").select(*gram.names).toPandas().to_numpy()
    monkeypatch.setattr(TruncatedSVD, "GRAM_COLUMNS", 0)
    wide = TruncatedSVD(columns, 3).fit(df)
    assert np.allclose(gram.components_, wide.components_, atol=1e-7)
    assert np.allclose(rows, wide.transform(df).orderBy("c0").select(*wide.names).toPandas().to_numpy(), atol=1e-6)
    assert wide.transform(df).columns == columns + wide.names
    df.unpersist()


def test_low_rank_nulls_and_no_rows(spark):
    x = np.outer(np.arange(1.0, 31.0), np.arange(1.0, 51.0))
    df, columns = wide_frame(spark, x)
    v, s = leading_vectors(df, columns, 3)
    assert np.isclose(s[0], np.linalg.norm(x)) and (s[1:] < 1e-9 * s[0]).all()
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-9)
    assert (leading_vectors(df.limit(0), columns, 2)[1] == 0).all()
    broken = df.selectExpr("if(c0 = 3, null, c0) as c0", *columns[1:])
    with pytest.raises(ValueError, match="null"):
        leading_vectors(broken, columns, 2)
    df.unpersist()


def test_embeddings_query_equals_numpy(spark, small):
    from tabstrata.plans.catalog.encoding import QUERIES

    got = QUERIES["x9_wide_svd"](spark, small).orderBy("vec_id").toPandas()
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(table["embedding"].to_list())[:, :64].astype(np.float64)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    v = vt[:3].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(3)])
    assert len(got) == len(x) and np.abs(got[["svd_0", "svd_1", "svd_2"]].to_numpy() - x @ v).max() < 1e-3
