"""Leading right singular vectors of a table with many columns, by a randomised block Krylov method.

The range finder starts from a random block (Halko, Martinsson & Tropp 2011) and adds one block a pass over the table, the
residuals of the best vectors found so far (Musco & Musco 2015): a pass returns X'(XQ) for the newest block Q, so neither X'X nor
XQ is ever held. As the images of all blocks are kept, the residuals of the result are known without another pass, and the search
ends when they are below the tolerance. A tall-skinny QR over the partitions (Demmel et al. 2012) then gives the singular values
without squaring them.

Scale: driver and tasks hold columns x block numbers (a block is ``n + oversample`` wide; at most ``blocks`` of them are kept,
then the best vectors start anew); a task keeps one triangular factor, and factors are merged in 256 groups before the last one
on the driver.

Cases: a null or NaN is refused with ValueError; fewer independent columns than components give singular values of zero; no rows
give zeros only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.learners.base import partial_sums

GROUPS = 256


def leading_vectors(
    df: DataFrame, columns: list[str], n: int, oversample: int = 10, tol: float = 1e-9, blocks: int = 8, max_passes: int = 200, seed: int = 42
) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, singular values) of the ``n`` leading right singular vectors of the uncentred table, one vector a column."""
    d = len(columns)
    width = min(n + oversample, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(max_passes):
        basis, images = np.hstack([basis, q]), np.hstack([images, _image(df, columns, q)])
        t = basis.T @ images
        values, w = np.linalg.eigh((t + t.T) / 2.0)
        w = w[:, ::-1][:, :width]
        values = values[::-1][:width]
        best, image = basis @ w, images @ w
        residual = image - best * values
        if np.linalg.norm(residual[:, :n], axis=0).max() <= tol * max(values[0], 0.0):
            break
        if basis.shape[1] + width > blocks * width:
            basis, images = best, image
        q = _new_directions(residual, basis)
        if not q.shape[1]:
            break  # the basis is closed under X'X
    else:
        raise ValueError(f"singular vectors did not settle in {max_passes} passes")
    # rotate by the factor of the table in these directions, whose singular values are those of the table
    _, s, turn = np.linalg.svd(triangular_factor(df, columns, best))
    return (best @ turn.T)[:, :n], s[:n]


def _image(df: DataFrame, columns: list[str], q: np.ndarray) -> np.ndarray:
    """X'(Xq), from one pass."""
    d, width = q.shape

    def add(pdf: pd.DataFrame, acc: np.ndarray) -> None:
        x = pdf.to_numpy(dtype=np.float64)
        acc += (x.T @ (x @ q)).ravel()

    out = partial_sums(df, columns, add, d * width).reshape(d, width)
    if not np.isfinite(out).all():
        raise ValueError("null, NaN or infinite values among the columns")
    return out


def _new_directions(residual: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning what ``residual`` adds to ``basis``."""
    norms = np.linalg.norm(residual, axis=0)
    r = residual[:, norms > 1e-14 * max(norms.max(), 1e-300)]
    r = r / np.linalg.norm(r, axis=0)
    for _ in range(2):  # a second time for what rounding left
        r = r - basis @ (basis.T @ r)
        u, s, _ = np.linalg.svd(r, full_matrices=False)
        r = u[:, s > 1e-10]
    return r[:, : basis.shape[0] - basis.shape[1]]


def triangular_factor(df: DataFrame, columns: list[str], v: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of XV: each task reduces its rows to one factor, and factors are stacked and reduced again."""
    width = v.shape[1]

    def merge(factors: list[np.ndarray]) -> np.ndarray:
        r = np.linalg.qr(np.vstack(factors), mode="r")
        return np.vstack([r, np.zeros((max(width - len(r), 0), width))])

    def task(batches):
        r = np.zeros((width, width))
        for batch in batches:
            r = merge([r, batch.to_pandas().to_numpy(dtype=np.float64) @ v])
        yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [merge([f.reshape(width, width) for f in pdf["r"]]).ravel()]})

    parts = df.select(*columns).mapInArrow(task, "r array<double>").withColumn("g", F.spark_partition_id() % GROUPS)
    found = parts.groupBy("g").applyInPandas(group, "r array<double>").toPandas()  # at most GROUPS factors
    return merge([np.zeros((width, width)), *[np.asarray(r).reshape(width, width) for r in found["r"]]])


def projected(df: DataFrame, columns: list[str], v: np.ndarray, names: list[str]) -> DataFrame:
    """``df`` with the rows of XV as columns ``names``."""

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_list()).astype(np.float64) @ v)) if len(rows) else pd.Series([], dtype=object)

    at = project(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
    return df.withColumn("__svd", at).select(*[F.col(f"`{c}`") for c in df.columns], *[F.get("__svd", F.lit(i)).alias(m) for i, m in enumerate(names)])
