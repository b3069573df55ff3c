"""The learner that is Spark's own: multinomial logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.learners.base import LinearModel, require_complete
from tabstrata.operators.encode import class_weight_table, weight_column


def assembled(df: DataFrame, features, label=None, weight=None, key=()) -> DataFrame:
    cols = [F.col(c) for c in key]
    if label:
        cols.append(F.col(label).cast("double").alias("__label"))
    if weight is not None:
        cols.append(weight.alias("__weight"))
    prepared = df.select(*cols, *features)
    out = VectorAssembler(inputCols=list(features), outputCol="__features").transform(prepared)
    return out.drop(*[f for f in features if f not in key])


def _weight(df: DataFrame, label: str, mode: str | None):
    if mode in (None, "none"):
        return F.lit(1.0)
    return weight_column(class_weight_table(df, label, mode), label)


class SparkLogistic:
    """Spark's multinomial logistic regression, penalty (1/C) * elastic net on the summed loss.

    Spark minimises the weighted mean loss, hence regParam = 1 / (C * sum of weights).
    """

    def __init__(self, k, C=1.0, l1_ratio=0.0, class_weight=None, fit_intercept=True, tol=1e-6, max_iter=1000):
        self.k, self.C, self.l1_ratio, self.class_weight = k, C, l1_ratio, class_weight
        self.fit_intercept, self.tol, self.max_iter = fit_intercept, tol, max_iter

    def fit(self, df: DataFrame, features, label) -> LinearModel:
        require_complete(df, features, label, self.k)
        weight = _weight(df, label, self.class_weight)
        total = df.agg(F.sum(weight)).first()[0]
        model = LogisticRegression(
            family="multinomial",
            featuresCol="__features",
            labelCol="__label",
            weightCol="__weight",
            regParam=1.0 / (self.C * total),
            elasticNetParam=self.l1_ratio,
            standardization=False,
            fitIntercept=self.fit_intercept,
            tol=self.tol,
            maxIter=self.max_iter,
        ).fit(assembled(df, features, label, weight))
        coef, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        if len(coef) < self.k:  # classes after the last one seen have no row
            coef = np.vstack([coef, np.zeros((self.k - len(coef), coef.shape[1]))])
            b = np.concatenate([b, np.full(self.k - len(b), -1e3)])
        return LinearModel(features, coef, b)
