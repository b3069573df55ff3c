"""Metrics as single aggregations, grouped by any key such as (model, fold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstrata.functions import proba as P


def row_log_loss(label, ps) -> Column:
    """-ln of the clipped probability of the true class."""
    return -F.log(P.clip(P.pick(ps, label)))


def log_loss(df: DataFrame, label: str, ps, by: list[str] | None = None, out="log_loss") -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(row_log_loss(label, ps)).alias(out))


def confusion(df: DataFrame, label: str, pred, by: list[str] | None = None) -> DataFrame:
    pred = F.col(pred) if isinstance(pred, str) else pred
    keyed = df.select(*(by or []), F.col(label).alias("y"), pred.alias("pred"))
    return keyed.groupBy(*(by or []), "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def balanced_accuracy(
    counts: DataFrame, by: list[str] | None = None, out: str = "balanced_accuracy"
) -> DataFrame:
    """Mean recall over the classes present in y, from :func:`confusion` counts."""
    by = by or []
    hit = F.when(F.col("pred") == F.col("y"), F.col("n")).otherwise(F.lit(0))
    recall = counts.groupBy(*by, "y").agg((F.sum(hit) / F.sum("n")).alias("__recall"))
    return recall.groupBy(*by).agg(F.avg("__recall").alias(out))


def negated_mean(scores: DataFrame, by: list[str], value: str = "log_loss", out="score") -> DataFrame:
    """Negated mean of per-fold losses, so that larger is better."""
    return scores.groupBy(*by).agg((-F.avg(value)).alias(out))


def running_mean(
    scores: DataFrame, trial: list[str], step: str = "fold", value: str = "score", out="running_mean"
) -> DataFrame:
    """Mean of the scores of a trial up to and including each step (k steps per trial)."""
    w = Window.partitionBy(*trial).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn(out, F.avg(value).over(w))
