"""Class weights of a whole log grid, scored from counts of cells.

A grid varies the weights of the classes 1 .. K-1 around a center by the factors 2**(unit * e), e in -half .. half; class 0
keeps its weight. Under a candidate, class y of a row beats class b if p_y c_y > p_b c_b 2**(unit * (e_b - e_y)), or if both are
equal and y < b. So all that a row of label y tells about all candidates is, for each other class b, how many of the 4 * half + 1
differences e_b - e_y leave y ahead: its cell, K - 1 small numbers. Rows are counted by (fold, label, cell) map-side; a cell
table summed up from above in every direction then holds, for every candidate, how many rows of the label it gets right.

Scale: a row is evaluated once per center, whatever the number of candidates, and only counts are shuffled. A table has
(4 * half + 2)**(K - 1) cells (at most ``MAX_CELLS``, else ValueError) and is built in one task per (fold, center, label).

Cases: rows whose label is null or no class count as a class that no candidate gets right; a null probability never wins, NaN
wins over all numbers, as in :func:`tabstrata.functions.proba.argmax`; probabilities are not negative; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 8_000_000


def grid_size(k: int, half: int) -> int:
    return (2 * half + 1) ** (k - 1)


def grid_weights(cand: int, centers: list[list[float]], half: int, unit: float) -> list[float]:
    """Weights of candidate ``cand``: candidates are numbered center by center, the last class varying fastest."""
    k, width = len(centers[0]), 2 * half + 1
    at, cand = divmod(cand, grid_size(k, half))
    steps = []
    for _ in range(k - 1):
        cand, e = divmod(cand, width)
        steps.append(2.0 ** (unit * (e - half)))
    return [centers[at][0]] + [c * s for c, s in zip(centers[at][1:], reversed(steps))]


def grid_scores(
    df: DataFrame,
    label: str,
    ps: list[str],
    fold: str | None,
    k_folds: int,
    mode: str,
    half: int = 4,
    unit: float = 1.0,
    centers: list[list[float]] | None = None,
) -> DataFrame:
    """(outer_fold, cand, balanced_accuracy) of every candidate around ``centers``, all ones if not given.

    ``mode`` "train" scores each fold's candidates on the rows of all other folds, "valid" on its own; without ``fold`` all rows
    are one fold, 0.
    """
    k = len(ps)
    centers = centers or [[1.0] * k]
    base = 4 * half + 2
    if base ** (k - 1) > MAX_CELLS:
        raise ValueError(f"a full grid of {k} classes has {grid_size(k, half)} candidates; search one class at a time")
    if mode not in ("train", "valid"):
        raise ValueError("mode is 'train' or 'valid'")
    cells = _cells(df, label, ps, F.col(fold) if fold else F.lit(0), half, unit, centers)

    def right(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, center, y = key
        shape = (base,) * (k - 1)
        hits = np.zeros(grid_size(k, half), dtype=np.int64)
        if 0 <= y < k:
            table = np.zeros(base ** (k - 1), dtype=np.int64)
            table[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
            table = table.reshape(shape)
            for axis in range(k - 1):  # from counts at a cell to counts of cells at least as far ahead
                back = np.flip(table, axis)
                table = np.flip(np.cumsum(back, axis=axis, out=back), axis)
            e = np.zeros((k, *((2 * half + 1,) * (k - 1))), dtype=np.int16)
            e[1:] = np.indices(e.shape[1:], dtype=np.int16) - half
            ahead = tuple((e[b] - e[y] + 2 * half + 1).ravel() for b in range(k) if b != y)
            hits = table[ahead].ravel() if k > 1 else table.ravel()
        cand = np.arange(len(hits), dtype=np.int32) + center * len(hits)
        return pd.DataFrame({"f": f, "cand": cand, "y": y, "hits": hits, "n": int(pdf["n"].sum())})

    counts = cells.groupBy("f", "center", "y").applyInPandas(right, "f int, cand int, y int, hits long, n long")
    sums = []
    for j in range(k_folds):
        of = F.col("f") == j if mode == "valid" else F.col("f") != j
        sums += [F.sum(F.when(of, F.col("hits"))).alias(f"h{j}"), F.sum(F.when(of, F.col("n"))).alias(f"n{j}")]
    recalls = counts.groupBy("cand", "y").agg(*sums)
    means = recalls.groupBy("cand").agg(*[F.avg(F.col(f"h{j}") / F.col(f"n{j}")).alias(f"b{j}") for j in range(k_folds)])
    folds = [F.struct(F.lit(j).alias("outer_fold"), F.col(f"b{j}").alias("balanced_accuracy")) for j in range(k_folds)]
    return means.select("cand", F.inline(F.array(*folds))).where("balanced_accuracy is not null")


def _cells(df, label, ps, fold: Column, half, unit, centers) -> DataFrame:
    """(f, center, y, cell, n): rows of each fold and label by cell."""
    k, base = len(ps), 4 * half + 2
    factors = [2.0 ** (unit * d) for d in range(-2 * half, 2 * half + 1)]
    y = F.when(F.col(label).between(0, k - 1), F.col(label)).otherwise(-1).cast("int")
    rows = df.select(fold.cast("int").alias("f"), y.alias("y"), *[F.col(p).cast("double").alias(f"p{b}") for b, p in enumerate(ps)])
    listed = [F.struct(F.lit(i).alias("center"), *[F.lit(float(w)).alias(f"c{b}") for b, w in enumerate(ws)]) for i, ws in enumerate(centers)]
    rows = rows.select("*", F.inline(F.array(*listed)))
    rows = rows.select("f", "center", "y", *[(F.col(f"p{b}") * F.col(f"c{b}")).alias(f"s{b}") for b in range(k)])
    own = F.lit(None).cast("double")
    for b in range(k):
        own = F.when(F.col("y") == b, F.col(f"s{b}")).otherwise(own)
    rows = rows.withColumn("own", own)
    cell = F.lit(0).cast("long")
    for b in range(k):
        other = F.col(f"s{b}")
        ahead = F.lit(0)
        for factor in factors:
            rival = other * F.lit(factor)
            wins = (F.col("own") > rival) | ((F.col("own") == rival) & (F.col("y") < b))
            ahead = ahead + F.when(wins, 1).otherwise(0)
        ahead = F.when(F.col("own").isNull(), 0).when(other.isNull(), len(factors)).otherwise(ahead)
        # the first of the other classes has the largest stride
        place = F.when(F.col("y") > b, base ** max(k - 2 - b, 0)).otherwise(base ** (k - 1 - b))
        cell = cell + F.when((F.col("y") == b) | (F.col("y") < 0), 0).otherwise(ahead * place)
    return rows.select("f", "center", "y", cell.alias("cell")).groupBy("f", "center", "y", "cell").agg(F.count("*").alias("n"))
