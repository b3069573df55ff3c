"""Column expressions on class margins and probabilities.

A probability row is a list of K numeric columns (stored form) throughout; every expression here
compiles into whole-stage code, with no array lambdas and no Python.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-15


def _cols(ps) -> list[Column]:
    return [F.col(p) if isinstance(p, str) else p for p in ps]


def total(ps) -> Column:
    return reduce(add, _cols(ps))


def row_max(ps) -> Column:
    cols = _cols(ps)
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def softmax(margins) -> list[Column]:
    """Softmax after subtracting the row maximum."""
    m = _cols(margins)
    top = row_max(m)
    e = [F.exp(x - top) for x in m]
    s = total(e)
    return [x / s for x in e]


def binary_columns(margin) -> list[Column]:
    """A single binary margin d as the two columns [1 - d, d]."""
    (d,) = _cols([margin])
    return [F.lit(1.0) - d, d]


def clip(p, eps: float = EPS) -> Column:
    (c,) = _cols([p])
    return F.greatest(F.least(c, F.lit(1.0 - eps)), F.lit(eps))


def replace_non_finite(p, eps: float = EPS) -> Column:
    """NaN and -inf become eps, +inf becomes 1 - eps."""
    (c,) = _cols([p])
    return (
        F.when(F.isnan(c), F.lit(eps))
        .when(c == F.lit(float("inf")), F.lit(1.0 - eps))
        .when(c == F.lit(float("-inf")), F.lit(eps))
        .otherwise(c)
    )


def weighted(ps, weights) -> list[Column]:
    """Per-class multiplication; weights are numbers or columns."""
    out = []
    for p, w in zip(_cols(ps), weights, strict=True):
        out.append(p * (w if isinstance(w, Column) else F.lit(float(w))))
    return out


def argmax(ps) -> Column:
    """Index of the largest value; the first index wins ties."""
    cols = _cols(ps)
    top = row_max(cols)
    branch = F.when(cols[0] == top, F.lit(0))
    for k, c in enumerate(cols[1:], start=1):
        branch = branch.when(c == top, F.lit(k))
    return branch


def renormalize(ps) -> list[Column]:
    """Divide by the row sum; a zero sum divides by one, so the row stays as it is."""
    cols = _cols(ps)
    s = total(cols)
    d = F.when(s == 0, F.lit(1.0)).otherwise(s)
    return [c / d for c in cols]


def normalize_or_uniform(ps) -> list[Column]:
    """Divide by the row sum; an all-zero row becomes 1/K."""
    cols = _cols(ps)
    s = total(cols)
    even = F.lit(1.0 / len(cols))
    return [F.when(s == 0, even).otherwise(c / F.when(s == 0, F.lit(1.0)).otherwise(s)) for c in cols]


def ovr_probabilities(margins, loss: str) -> list[Column]:
    """One-vs-rest margins to probabilities.

    ``log_loss``: sigmoid; ``modified_huber``: (clip(d, -1, 1) + 1) / 2; both row-normalised.
    ``hinge`` and ``perceptron`` have no probability of their own and go through softmax.
    """
    m = _cols(margins)
    if loss == "log_loss":
        raw = [F.lit(1.0) / (F.lit(1.0) + F.exp(-x)) for x in m]
    elif loss == "modified_huber":
        raw = [(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0 for x in m]
    elif loss in ("hinge", "perceptron", "squared_hinge"):
        return softmax(m)
    else:
        raise ValueError(f"unknown loss {loss!r}")
    return normalize_or_uniform(raw)


def pick(ps, index) -> Column:
    """Value of the column whose position equals ``index``."""
    cols = _cols(ps)
    i = F.col(index) if isinstance(index, str) else index
    branch = F.when(i == 0, cols[0])
    for k, c in enumerate(cols[1:], start=1):
        branch = branch.when(i == k, c)
    return branch


def named(cols, prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}_{k}") for k, c in enumerate(cols)]
