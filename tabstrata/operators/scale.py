"""Scalers, the column-wise composition of encoders and scalers, and truncated SVD."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.operators.encode import TargetEncoder
from tabstrata.operators.quantiles import EXACT_LIMIT, quantiles
from tabstrata.operators.wide_svd import leading_vectors, projected


class StandardScaler:
    """(x - mean) / population standard deviation; a constant column is divided by one."""

    def __init__(self, columns, out="{col}"):
        self.columns, self.out = list(columns), out

    def fit(self, df: DataFrame) -> "StandardScaler":
        aggs = []
        for c in self.columns:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        self.mean_ = {c: row[f"m_{c}"] for c in self.columns}
        self.scale_ = {c: row[f"s_{c}"] or 1.0 for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                self.out.format(col=c): (F.col(c) - F.lit(self.mean_[c])) / F.lit(self.scale_[c])
                for c in self.columns
            }
        )


class RobustScaler:
    """(x - median) / interquartile range, from exact quantiles; a zero range divides by one."""

    def __init__(self, columns, out="{col}", exact_limit=EXACT_LIMIT):
        self.columns, self.out, self.exact_limit = list(columns), out, exact_limit

    def fit(self, df: DataFrame) -> "RobustScaler":
        q = quantiles(df, self.columns, [0.25, 0.5, 0.75], exact_limit=self.exact_limit)[()]
        self.median_ = {c: q[c][1] for c in self.columns}
        self.scale_ = {c: (q[c][2] - q[c][0]) or 1.0 for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                self.out.format(col=c): (F.col(c) - F.lit(self.median_[c])) / F.lit(self.scale_[c])
                for c in self.columns
            }
        )


class ColumnComposer:
    """Target-encode some columns, standardise others, robust-scale the rest; one fitted object.

    ``fit_transform`` cross-fits the target encoding over ``fold``; ``transform`` uses all of train.
    """

    def __init__(self, categories, standard, robust, k: int, smooth: float | str = "auto"):
        self.categories, self.standard, self.robust = list(categories), list(standard), list(robust)
        self.encoder = TargetEncoder(self.categories, k, smooth)
        self.std, self.rob = StandardScaler(self.standard), RobustScaler(self.robust)

    @property
    def features(self) -> list[str]:
        return self.encoder.names() + self.standard + self.robust

    def fit(self, train: DataFrame, label: str) -> "ColumnComposer":
        if self.categories:
            self.encoder.fit(train, label)
        return self._fit_scalers(train)

    def _fit_scalers(self, train: DataFrame) -> "ColumnComposer":
        if self.standard:
            self.std.fit(train)
        if self.robust:
            self.rob.fit(train)
        return self

    def _scaled(self, df: DataFrame) -> DataFrame:
        if self.standard:
            df = self.std.transform(df)
        return self.rob.transform(df) if self.robust else df

    def transform(self, df: DataFrame) -> DataFrame:
        return self._scaled(self.encoder.transform(df) if self.categories else df)

    def fit_transform(self, train: DataFrame, label: str, fold: str, k_folds: int) -> DataFrame:
        self._fit_scalers(train)
        if self.categories:
            train = self.encoder.fit_transform(train, label, fold, k_folds)
        return self._scaled(train)


def gram_entries(df: DataFrame, columns: list[str]) -> DataFrame:
    """Uncentred Gram matrix X'X as rows (i, j, value), i <= j, from one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i, j in pairs]
    entries = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("value"))
        for i, j in pairs
    ]
    return df.agg(*sums).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


class TruncatedSVD:
    """Projection on the leading right singular vectors of the uncentred matrix.

    For few columns the d x d Gram matrix is one Spark aggregate, its eigenvectors are found on the driver, and projecting rows
    is a column expression. Beyond ``GRAM_COLUMNS`` the vectors come from passes over the table
    (:mod:`tabstrata.operators.wide_svd`); both ways agree to rounding. Signs are fixed so that the largest loading of each
    component is positive.
    """

    GRAM_COLUMNS = 40

    def __init__(self, columns, n_components: int, out="svd_{i}"):
        self.columns, self.n, self.out = list(columns), min(n_components, len(columns)), out

    @property
    def names(self) -> list[str]:
        return [self.out.format(i=i) for i in range(self.n)]

    def fit(self, df: DataFrame) -> "TruncatedSVD":
        d = len(self.columns)
        if d > self.GRAM_COLUMNS:
            v, singular = leading_vectors(df, self.columns, self.n)
        else:
            gram = np.zeros((d, d))
            for r in gram_entries(df, self.columns).collect():  # d(d+1)/2 rows
                gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["value"]
            values, vectors = np.linalg.eigh(gram)
            order = np.argsort(values)[::-1][: self.n]
            v, singular = vectors[:, order], np.sqrt(np.maximum(values[order], 0.0))
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        self.components_, self.singular_values_ = v.T, singular
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if len(self.columns) > self.GRAM_COLUMNS:
            return projected(df, self.columns, self.components_.T, self.names)
        exprs = []
        for name, row in zip(self.names, self.components_):
            acc = F.col(self.columns[0]) * F.lit(float(row[0]))
            for c, w in zip(self.columns[1:], row[1:]):
                acc = acc + F.col(c) * F.lit(float(w))
            exprs.append(acc.alias(name))
        return df.select("*", *exprs)
