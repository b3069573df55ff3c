"""Isotonic calibration (pool adjacent violators) for many (fold, class) pairs in one job.

Equal scores are merged first. The merged scores are range-partitioned, so no (fold, class) group
has to fit in one task: every task pools its own stretch, and the few blocks that remain are pooled
once more per group. Pooling stretches first does not change the result (Zadrozny & Elkan 2002;
Barlow et al. 1972).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BLOCKS = 2_000_000


def _pool(stack: list, lo: float, hi: float, total: float, n: float) -> None:
    """Append a block and merge backwards while the means do not increase."""
    while stack and stack[-1][2] * n >= total * stack[-1][3]:
        plo, _, ptotal, pn = stack.pop()
        lo, total, n = plo, total + ptotal, n + pn
    stack.append((lo, hi, total, n))


def pooled(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Blocks (lo, hi, total, n) of one group in order of ``lo``, pooled until their means increase.

    Neighbours whose means do not increase share a block of the solution, so whole falling stretches are pooled
    at a time, for all of the group at once. Where rounds stop paying, the rest is pooled block by block.
    """
    parts = [lo, hi, total, n]
    while len(parts[0]) > 1:
        lo, hi, total, n = parts
        rises = total[:-1] * n[1:] < total[1:] * n[:-1]
        if rises.all():
            break
        first = np.r_[0, np.flatnonzero(rises) + 1]
        last = np.r_[first[1:], len(lo)] - 1
        parts = [lo[first], hi[last], np.add.reduceat(total, first), np.add.reduceat(n, first)]
        if len(first) > 0.9 * len(lo):
            stack = []
            for block in zip(*(x.tolist() for x in parts)):
                _pool(stack, *block)
            return [np.array(x, dtype=float) for x in zip(*stack)]
    return parts


def isotonic_blocks(df: DataFrame, by: list[str], score: str, target: str) -> DataFrame:
    """(by..., lo, hi, value, n): the increasing step function of ``target`` over ``score``.

    ``by`` must be integer columns and ``target`` 0/1 or any number.
    """
    if not by:
        raise ValueError("give at least one grouping column")
    merged = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(target).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("n")
    )
    keys = [T.StructField(b, T.IntegerType()) for b in by]
    partial = T.StructType(keys + [T.StructField(c, T.DoubleType()) for c in ("lo", "hi", "total", "n")])
    final = T.StructType(keys + [T.StructField(c, T.DoubleType()) for c in ("lo", "hi", "value", "n")])
    names = [*by, "lo", "hi", "total", "n"]

    def stretch(batches):
        current, parts, kept = None, [], 0  # a group's blocks, pooled again whenever there are twice as many
        for pdf in batches:
            if not len(pdf):
                continue
            ids, values = pdf[by].to_numpy(), [pdf[c].to_numpy() for c in ("score", "score", "total", "n")]
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ids)]):
                group = tuple(ids[a].tolist())
                if group != current:
                    if parts:
                        yield frame(current, joined(parts))
                    current, parts, kept = group, [], 0
                parts.append(pooled(*(v[a:b] for v in values)))
                if sum(len(x[0]) for x in parts) > 2 * kept + 10_000:
                    parts = [joined(parts)]
                    kept = len(parts[0][0])
        if parts:
            yield frame(current, joined(parts))

    def joined(parts: list) -> list[np.ndarray]:
        return pooled(*map(np.concatenate, zip(*parts)))

    def frame(group, blocks) -> pd.DataFrame:
        out = pd.DataFrame(dict(zip(["lo", "hi", "total", "n"], blocks)))
        for b, v in zip(by, group):
            out[b] = v
        return out[names]

    def join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        out = pd.DataFrame(dict(zip(["lo", "hi", "total", "n"], pooled(*(pdf[c].to_numpy() for c in ("lo", "hi", "total", "n"))))))
        out["value"] = out["total"] / out["n"]
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[[*by, "lo", "hi", "value", "n"]]

    ordered = (
        merged.withColumns({b: F.col(b).cast("int") for b in by})
        .repartitionByRange(*by, "score")
        .sortWithinPartitions(*by, "score")
    )
    blocks = ordered.mapInPandas(stretch, partial)
    return blocks.groupBy(*by).applyInPandas(join_blocks, final)


class IsotonicMaps:
    """Fitted step functions per key, linearly interpolated between block edges when applied."""

    def __init__(self, curves: dict[tuple, tuple[np.ndarray, np.ndarray]]):
        self.curves = curves

    @classmethod
    def fit(cls, df: DataFrame, by: list[str], score: str, target: str) -> "IsotonicMaps":
        blocks = isotonic_blocks(df, by, score, target).limit(MAX_BLOCKS + 1).toArrow().to_pandas()
        if len(blocks) > MAX_BLOCKS:
            raise ValueError("too many isotonic blocks; round the scores before fitting")
        curves = {}
        for key, part in blocks.groupby(by):
            part = part.sort_values("lo")
            x = part[["lo", "hi"]].to_numpy().ravel()
            y = np.repeat(part["value"].to_numpy(), 2)
            curves[tuple(int(k) for k in (key if isinstance(key, tuple) else (key,)))] = (x, y)
        return cls(curves)

    def apply(self, key: tuple, score: np.ndarray) -> np.ndarray:
        if key not in self.curves:
            return np.zeros_like(score)
        x, y = self.curves[key]
        return np.interp(score, x, y)


def ensemble_probabilities(maps: IsotonicMaps, margins: np.ndarray) -> np.ndarray:
    """(n, members, K) margins -> (n, K): calibrate, normalise each member's rows, average."""
    n, members, k = margins.shape
    out = np.zeros((n, k))
    for m in range(members):
        p = np.column_stack([maps.apply((m, c), margins[:, m, c]) for c in range(k)])
        s = p.sum(axis=1, keepdims=True)
        out += np.where(s == 0, 1.0 / k, p / np.where(s == 0, 1.0, s))
    return out / members
