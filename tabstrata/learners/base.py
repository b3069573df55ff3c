"""What every learner shares: fold-parallel fits, scoring, and sums over all partitions.

A fit over k folds trains k + 1 models at once: model j leaves out fold j, the last one sees all
rows. Each pass over the data returns the sufficient statistics of all of them, so cross-validation
costs the passes of a single fit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstrata.functions import proba as P
from tabstrata.runtime import bounded_batches


def require_complete(df: DataFrame, features: list[str], label: str | None = None, k: int | None = None) -> np.ndarray:
    """Means of the features, from one scan of these columns.

    Learners train on complete rows: a null or NaN among the features, a null label, or a label that
    is no class 0 .. k - 1 raises ValueError, whatever the learner, the width and the partitioning.
    """
    x = [F.col(f"`{c}`").cast("double") for c in features]
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]
    aggs += [F.count_if(c.isNull() | F.isnan(c)).alias(f"n{i}") for i, c in enumerate(x)]
    if label is not None:
        y = F.col(f"`{label}`")
        outside = (y < 0) | (y >= k) if k else F.lit(False)
        aggs += [F.count_if(y.isNull() | outside).alias("labels")]
    row = df.agg(*aggs).first()
    refuse({c: row[f"n{i}"] for i, c in enumerate(features)}, row["labels"] if label is not None else 0, label)
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(features))])


def refuse(missing: dict[str, int], labels: int, label: str | None) -> None:
    """ValueError if rows miss a feature or a label."""
    missing = {c: n for c, n in missing.items() if n}
    if missing:
        raise ValueError(f"null or NaN features (rows): {missing}")
    if labels:
        raise ValueError(f"{labels} rows whose {label} is null or no class")


def feature_sets(features, models: int) -> list[list[str]]:
    """The feature columns of each model: the same for all, or one list for each."""
    features = list(features)
    if features and not isinstance(features[0], str):
        if len(features) != models:
            raise ValueError(f"{len(features)} feature lists for {models} models")
        return [list(f) for f in features]
    return [features] * models


#: The column of :func:`blocks`.
ROWS = "__rows"


def blocks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` as blocks: one binary column, each value an Arrow batch of some thousand rows.

    A pass over training rows does a few sums for each, and handing every number of every row to Python would
    cost more than these. A block is handed over as a whole, and its columns are read where they lie.
    """

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield block_of(batch)

    df = df.select(*columns) if columns else df
    return bounded_batches(df).mapInArrow(task, f"{ROWS} binary")


def block_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row of :func:`blocks`."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[ROWS])


#: Bytes from which on batches are not joined further.
JOINED = 32 << 20


def joined(batches, rows: int):
    """The rows of some batches in fewer batches, of ``rows`` rows or ``JOINED`` bytes at least but for the last."""
    kept, n, size = [], 0, 0
    for batch in batches:
        kept.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= JOINED:
            yield _one(kept)
            kept, n, size = [], 0, 0
    if n:
        yield _one(kept)


def _one(batches) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def rows_of(batch: pa.RecordBatch):
    """The batches of rows that a batch of blocks holds."""
    for value in batch.column(0):
        yield from pa.ipc.open_stream(value.as_py())


def partial_sums(
    df: DataFrame, columns: list[str], add: Callable[[pd.DataFrame, np.ndarray], None], length: int, arrow: bool = False
) -> np.ndarray:
    """Sum of a fixed-length vector over all rows of ``df``, which may come in :func:`blocks`.

    ``add(batch, acc)`` adds the contribution of a batch, a pandas frame or with ``arrow`` a record batch, in place. Each partition emits its own sum
    once, cut into blocks of packed strips that are not zero; a group per block adds them up in the order of
    the partitions, and the driver receives the vector (coefficients or histograms), never rows. A NaN
    makes the sum NaN. Hash aggregates of single numbers would allocate their pages in every task of every pass.
    """

    packed = df.columns == [ROWS]

    def task(batches):
        acc = np.zeros(-(-length // STRIP) * STRIP)
        seen = False
        for batch in (rows for b in batches for rows in rows_of(b)) if packed else batches:
            if batch.num_rows:
                seen = True
                add(batch if arrow else batch.select(columns).to_pandas(), acc[:length])
        if seen:
            part = TaskContext.get().partitionId()
            table = acc.reshape(-1, STRIP)
            used = np.flatnonzero(table.any(axis=1))
            cuts = np.searchsorted(used, np.arange(0, len(table) + BLOCK_STRIPS, BLOCK_STRIPS))
            for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    yield _block(block, part, used[a:b].astype(np.int32), table[used[a:b]])

    def merged(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")
        block = parts.column("block")[0].as_py()
        total = np.zeros((BLOCK_STRIPS, STRIP))
        for at, values in zip(parts.column("strip"), parts.column("value")):
            total[_strips(at) - block * BLOCK_STRIPS] += _values(values)
        used = np.flatnonzero(total.any(axis=1))
        return pa.Table.from_batches([_block(block, 0, (used + block * BLOCK_STRIPS).astype(np.int32), total[used])])

    parts = (df if packed else df.select(*columns)).mapInArrow(task, _BLOCKS)
    sums = parts.groupBy("block").applyInArrow(merged, _BLOCKS).select("strip", "value").toArrow()
    out = np.zeros((-(-length // STRIP), STRIP))
    for at, values in zip(sums.column("strip"), sums.column("value")):
        out[_strips(at)] = _values(values)
    return out.ravel()[:length]


#: Numbers to a strip, and strips to a block: at most 1 MB of a vector in one row.
STRIP, BLOCK_STRIPS = 8, 1 << 14
_BLOCKS = "block int, part int, strip binary, value binary"


def _block(block: int, part: int, strips: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    ints = [pa.array([x], pa.int32()) for x in (block, part)]
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (strips, values)]
    return pa.RecordBatch.from_arrays([*ints, *packed], names=["block", "part", "strip", "value"])


def _strips(at) -> np.ndarray:
    return np.frombuffer(at.as_buffer(), np.int32)


def _values(values) -> np.ndarray:
    return np.frombuffer(values.as_buffer(), np.float64).reshape(-1, STRIP)


def compact(x: np.ndarray) -> pa.Array:
    """Numbers as they are, or as a dictionary of at most 256 of them."""
    coded = pa.array(x).dictionary_encode()
    if len(coded.dictionary) > 256:
        return pa.array(x)
    return pa.DictionaryArray.from_arrays(coded.indices.cast(pa.uint8()), coded.dictionary)


def numbers(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.DictionaryArray):
        return column.dictionary.to_numpy()[column.indices.to_numpy()]
    return column.to_numpy()


def require_complete_blocks(state: DataFrame, columns: dict[str, str], y: str, label: str) -> None:
    """:func:`require_complete` for rows in :func:`blocks`: ``columns`` are the features and where blocks hold them,
    and ``y`` is less than 0 where a label is null or no class."""
    held = list(dict.fromkeys(columns.values()))

    def add(batch, acc):
        acc[:-1] += [np.isnan(numbers(batch.column(c))).sum() for c in held]
        acc[-1] += (batch.column(y).to_numpy() < 0).sum()

    *missing, labels = partial_sums(state, [ROWS], add, len(held) + 1, True).astype(int).tolist()
    refuse({c: missing[held.index(h)] for c, h in columns.items()}, labels, label)


def sources(columns: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The columns to read for some features, and (place, middle, spread) of each feature: a scaled column
    (:class:`tabstrata.operators.fold_prep.Scaled`) is read as its source, once for all models."""
    names = [getattr(c, "source", c) for c in columns]
    read = list(dict.fromkeys(names))
    spots = np.array([read.index(n) for n in names])
    return read, spots, *(np.array([getattr(c, a, b) for c in columns]) for a, b in (("middle", 0.0), ("spread", 1.0)))


#: Part of a row that is in no part at all.
NO_PART = -9


class ModelRows:
    """The rows of several models in :func:`blocks`, cached once for all of them until ``close``.

    ``sets`` are the features of each model, and ``parts`` integer columns such as folds (null: :data:`NO_PART`). A scaled
    column is held as its source, once for all models, and columns of few values as dictionaries, so that a row
    takes little more than its own numbers, however many models there are.
    """

    def __init__(self, df: DataFrame, sets: list[list[str]], label: str, k: int, parts: list[Column]):
        columns = list(dict.fromkeys(c for s in sets for c in s))
        read, spots, middle, spread = sources(columns)
        at, width = {c: i for i, c in enumerate(columns)}, len(read)
        self.sets, self.k = sets, k
        self.scales = [(spots[o], middle[o][:, None], spread[o][:, None]) for o in ([at[c] for c in s] for s in sets)]
        names = [f"x{i}" for i in range(width)] + ["y"] + [f"part{i}" for i in range(len(parts))]

        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    xs = [c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns[:width]]
                    yield block_of(pa.RecordBatch.from_arrays([*map(compact, xs), *batch.columns[width:]], names=names))

        y = F.col(f"`{label}`")
        rows = df.select(
            *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(read)],
            F.when((y >= 0) & (y < k), y.cast("int")).otherwise(-1).alias("__y"),
            *[F.coalesce(p.cast("int"), F.lit(NO_PART)).alias(f"__part{i}") for i, p in enumerate(parts)],
        )
        self.frame = bounded_batches(rows).mapInArrow(pack, f"{ROWS} binary").persist()
        try:
            require_complete_blocks(self.frame, {c: f"x{s}" for c, s in zip(columns, spots)}, "y", label)
        except ValueError:
            self.close()
            raise

    def close(self) -> None:
        self.frame.unpersist()

    def counts(self, part: int, parts: int) -> np.ndarray:
        """(parts + 1, K) rows by the value of a part and the label, the last of all other values; those of no part count nowhere."""
        k = self.k

        def add(batch, acc):
            y, f = part_of(batch, part)
            f = np.where((f >= 0) & (f < parts), f, parts)
            acc += np.bincount(f * k + y, minlength=len(acc))

        return partial_sums(self.frame, [ROWS], add, (parts + 1) * k, True).reshape(parts + 1, k)


def part_of(batch: pa.RecordBatch, part: int, rows: bool = False):
    """(labels, values of a part) of the rows of a block of :class:`ModelRows` that are in it; with ``rows`` also which."""
    y, f = batch.column("y").to_numpy(), batch.column(f"part{part}").to_numpy()
    kept = np.flatnonzero(f != NO_PART)
    found = (y, f) if len(kept) == len(f) else (y[kept], f[kept])
    return (*found, kept) if rows else found


def scaled_rows(batch: pa.RecordBatch, scale, kept: np.ndarray | None = None) -> np.ndarray:
    """(features + 1, rows): a model's features of some rows of a block, and a row of ones."""
    spots, middle, spread = scale
    x = np.ones((len(spots) + 1, batch.num_rows if kept is None else len(kept)))
    for i, s in enumerate(spots):
        found = numbers(batch.column(f"x{s}"))
        x[i] = found if kept is None else found[kept]
    x[:-1] -= middle
    x[:-1] /= spread
    return x


class Model:
    """A fitted model: numpy scoring for wide inputs, SQL expressions where they stay short."""

    features: list[str]
    k: int

    def prepare(self, df: DataFrame) -> DataFrame:
        """Adds the input columns the model derives itself, such as category codes."""
        return df

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def expressions(self) -> list[str] | None:
        """K SQL expressions of the probabilities, or None when they would be too long."""
        return None

    def score(self, df: DataFrame, prefix: str) -> DataFrame:
        """``df`` plus the columns prefix_0 .. prefix_{K-1}."""
        return score(df, [self], prefix)


def as_matrix(columns) -> np.ndarray:
    return np.column_stack([np.asarray(c, dtype=np.float64) for c in columns])


def score(df: DataFrame, models: list[Model], prefix: str, fold: str | None = None) -> DataFrame:
    """Score with one model, or with model ``fold`` of a list: out-of-fold in a single pass."""
    texts = [m.expressions() for m in models]
    k = models[0].k
    if all(t is not None for t in texts) and sum(len(e) for t in texts for e in t) < 20_000:
        cols = []
        for c in range(k):
            if fold is None:
                cols.append(F.expr(texts[0][c]))
            else:
                cases = " ".join(f"when {j} then {t[c]}" for j, t in enumerate(texts))
                cols.append(F.expr(f"case `{fold}` {cases} end"))
        return df.select("*", *P.named(cols, prefix))
    features = models[0].features

    # a struct of numbers goes back column by column; an array would be made row by row
    @F.pandas_udf(T.StructType([T.StructField(f"p{c}", T.DoubleType()) for c in range(k)]))
    def probabilities(part: pd.Series, *xs: pd.Series) -> pd.DataFrame:
        x, which = as_matrix(xs), part.to_numpy()
        out = np.zeros((len(which), k))
        for j in np.unique(which):
            rows = which == j
            out[rows] = models[int(j)].predict_array(x[rows])
        return pd.DataFrame({f"p{c}": out[:, c] for c in range(k)})

    part = F.col(fold) if fold else F.lit(0)
    inputs = [F.col(c) for c in features]
    if fold and any(m.features != features for m in models):  # columns encoded for each model
        sets = [m.features for m in models]
        inputs = [F.expr(f"case `{fold}` {' '.join(f'when {j} then `{s[p]}`' for j, s in enumerate(sets))} end") for p in range(len(features))]
    scored = models[0].prepare(df).withColumn("__p", probabilities(part, *inputs))
    return scored.select(*df.columns, *[F.col("__p")[f"p{c}"].alias(f"{prefix}_{c}") for c in range(k)])


def leaves(feature: np.ndarray, child: np.ndarray, right: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row in a tree of bins: the children of node n are child[n] and child[n] + 1, feature -1 is
    a leaf, and ``right`` (nodes, bins) tells which bins go to the second child."""
    inner, depth = np.flatnonzero(feature >= 0), 0
    level = np.zeros(1, np.int64)
    while (level := level[feature[level] >= 0]).size:
        level, depth = np.concatenate([child[level], child[level] + 1]), depth + 1
    column, first = np.zeros(len(feature), np.int64), np.arange(len(feature))  # a leaf is its own first child
    column[inner], first[inner] = feature[inner], child[inner]
    turn = np.zeros(right.shape, np.int64)
    turn[inner] = right[inner]
    turn, width, flat = turn.ravel(), right.shape[1], bins.ravel()
    rows, at = np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
    for _ in range(depth):
        at = first[at] + turn[at * width + flat[rows + column[at]]]
    return at


def softmax_array(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def link_array(m: np.ndarray, link: str) -> np.ndarray:
    """Margins to probabilities, as in :mod:`tabstrata.functions.proba`."""
    if link == "softmax":
        return softmax_array(m)
    if link == "log_loss":
        raw = 1.0 / (1.0 + np.exp(-np.clip(m, -700.0, 700.0)))
    else:
        raw = (np.clip(m, -1.0, 1.0) + 1.0) / 2.0
    s = raw.sum(axis=1, keepdims=True)
    return np.where(s == 0, 1.0 / m.shape[1], raw / np.where(s == 0, 1.0, s))


class LinearModel(Model):
    """Margins W x + b with a link: softmax, log_loss or modified_huber."""

    def __init__(self, features, coef: np.ndarray, intercept: np.ndarray, link: str = "softmax"):
        self.features, self.coef, self.intercept, self.link = list(features), coef, intercept, link
        self.k = coef.shape[0]

    def margin_array(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef.T + self.intercept

    def predict_array(self, x):
        return link_array(self.margin_array(x), self.link)

    def margin_texts(self) -> list[str]:
        return [
            " + ".join([f"{b!r}D"] + [f"`{f}` * {v!r}D" for f, v in zip(self.features, map(float, w))])
            for w, b in zip(self.coef, map(float, self.intercept))
        ]

    def margins(self) -> list[Column]:
        return [F.expr(t) for t in self.margin_texts()]

    def expressions(self):
        if self.link != "softmax" or self.k * len(self.features) > 60:
            return None
        return softmax_texts(self.margin_texts())


def softmax_texts(margins: list[str]) -> list[str]:
    """p_k = 1 / sum_j exp(m_j - m_k); the exponent is clipped so that no term overflows."""
    out = []
    for k, mk in enumerate(margins):
        terms = ["1D"] + [
            f"exp(least(({mj}) - ({mk}), 700D))" for j, mj in enumerate(margins) if j != k
        ]
        out.append(f"1D / ({' + '.join(terms)})")
    return out


def training_rows(fold: np.ndarray | None, n: int, held_out: list[int]) -> np.ndarray:
    """(n, models) mask: model m trains on a row unless it is in the fold it leaves out (-1: none)."""
    if fold is None:
        return np.ones((n, len(held_out)), dtype=bool)
    return fold[:, None] != np.asarray(held_out)[None, :]
