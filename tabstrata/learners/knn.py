"""Exact k-nearest-neighbour join and vote (truncated SVD -> standardise -> k-NN).

The training points are cut into cells of similar size by axis-parallel medians (taken from a
bounded sample, which affects speed only). Every query first searches its own cell, which gives no
more than its k-th distance there; this bound rules out all cells whose bounding box lies farther
away, and the cells that remain are searched for the neighbours. The join is an equi-join on (cell, query chunk, training chunk): both sides of a
crowded cell are cut into chunks, so no task ever holds an unbounded group, and a task emits k rows
per query instead of pairs. Of identical training points only the k with the smallest keys can be
among the k nearest, so copies are dropped beforehand without changing the result.

Order is by (distance, key). With a ``group`` column a query never meets training points of its own
group, which gives out-of-fold neighbours for all folds in one join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstrata.functions import proba as P
from tabstrata.functions.hashing import unit_hash
from tabstrata.learners.base import as_matrix, require_complete
from tabstrata.operators.scale import StandardScaler, TruncatedSVD
from tabstrata.runtime import drop_shuffles, fewer_tasks, materialize, small_rows

MAX_CELLS = 1 << 16
#: Rows of the sample for each cell, at most; a few thousand cells stay bounded by a small matrix on the driver.
SAMPLE_PER_CELL, SAMPLE_ROWS = 8, 20_000
#: Numbers that the boxes of all cells may take for some queries at once.
BALL_CELLS = 1 << 24
#: Features up to which boxes rule out most cells.
PRUNED = 12


class Cells:
    """Axis-parallel median splits, as arrays indexed like a heap."""

    def __init__(self, sample: np.ndarray, levels: int):
        n = 2**levels - 1
        self.levels, self.axis, self.cut = levels, np.zeros(n, dtype=int), np.zeros(n)
        parts = {0: sample}
        for node in range(n):
            x = parts.pop(node)
            if len(x):
                self.axis[node] = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                self.cut[node] = np.median(x[:, self.axis[node]])
            right = x[:, self.axis[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = x[~right], x[right]

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.levels):
            at = 2 * at + 1 + (x[rows, self.axis[at]] > self.cut[at])
        return at - (2**self.levels - 1)

    def boxes(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> "Boxes":
        """The bounding boxes of all nodes from those of the cells that hold points."""
        leaves, d = 2**self.levels, low.shape[1] if len(ids) else 0
        lo, hi = np.full((2 * leaves - 1, d), np.inf), np.full((2 * leaves - 1, d), -np.inf)
        lo[leaves - 1 + ids], hi[leaves - 1 + ids] = low, high
        for level in range(self.levels - 1, -1, -1):
            a, b = 2**level - 1, 2 ** (level + 1) - 1
            lo[a:b] = np.minimum(lo[2 * a + 1 : 2 * b + 1 : 2], lo[2 * a + 2 : 2 * b + 1 : 2])
            hi[a:b] = np.maximum(hi[2 * a + 1 : 2 * b + 1 : 2], hi[2 * a + 2 : 2 * b + 1 : 2])
        return Boxes(self.levels, lo, hi)


class Boxes:
    """Which cells a ball reaches, from the root down: a node whose box lies beyond it is not entered."""

    def __init__(self, levels: int, low: np.ndarray, high: np.ndarray):
        self.levels, self.low, self.high = levels, low, high

    def reached(self, x: np.ndarray, limit: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs in the order of rows and cells."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for level in range(self.levels + 1):
            if level:
                rows = np.repeat(rows, 2)
                nodes = (2 * nodes[:, None] + (1, 2)).ravel()
            gap = np.maximum(np.maximum(self.low[nodes] - x[rows], x[rows] - self.high[nodes]), 0.0)
            d = gap.sum(axis=1) if p == 1 else np.sqrt((gap**2).sum(axis=1))
            # empty nodes are infinitely far, also from a ball without a bound
            near = (d <= limit[rows]) & np.isfinite(self.low[nodes, 0])
            rows, nodes = rows[near], nodes[near]
        return rows, nodes - (2**self.levels - 1)


def _distances(q: np.ndarray, t: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((len(q), len(t)))
    for j in range(q.shape[1]):
        gap = np.abs(q[:, j, None] - t[None, :, j])
        out += gap if p == 1 else gap * gap
    return out if p == 1 else np.sqrt(out)


def _pair_distances(q: np.ndarray, t: np.ndarray, p: int) -> np.ndarray:
    """Distances row by row, the same bits as those of ``_distances``."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        gap = np.abs(q[:, j] - t[:, j])
        out += gap if p == 1 else gap * gap
    return out if p == 1 else np.sqrt(out)


class _Bounds:
    """Squared Euclidean distances by one matrix product, and how far two of them may be off together."""

    def __init__(self, t: np.ndarray):
        self.middle = t.mean(axis=0) if len(t) else 0.0
        self.t = t - self.middle
        self.norms = (self.t * self.t).sum(axis=1)

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """None where the squares leave the range of doubles."""
        q = q - self.middle
        norms = (q * q).sum(axis=1)[:, None]
        most = norms + (self.norms.max() if len(self.norms) else 0.0)
        if not (most < 1e300).all():
            return None
        near = q @ self.t.T
        near *= -2.0
        near += norms
        near += self.norms
        # twice the rounding of d products, sums and shifts, each relative to the squares of the shifted rows
        return near, 1e-15 * (64 + 8 * q.shape[1]) * most + 1e-300


def _nearest(q, t, q_group, t_group, t_key, k, p):
    """(query index, training index, distance) of the k nearest, by (distance, key)."""
    order = np.argsort(t_key, kind="stable")
    t, t_group, idx = t[order], t_group[order], order  # columns in key order
    rows, cols, dist = [], [], []
    bounds = _Bounds(t) if p == 2 else None
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        near, slack = (bounds and bounds.of(part)) or (_distances(part, t, p), 0.0)
        near[q_group[a : a + 256, None] == t_group[None, :]] = np.inf
        if near.shape[1] > k:
            kth = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero((near <= kth + slack) & np.isfinite(near))  # at least k, with all ties
        else:
            r, c = np.nonzero(np.isfinite(near))
        v = _pair_distances(part[r], t[c], p)
        by = np.lexsort((c, v, r))  # columns are in key order
        r, c, v = r[by], c[by], v[by]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        keep = place < k
        rows.append(r[keep] + a)
        cols.append(idx[c[keep]])
        dist.append(v[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    key: str,
    features: list[str],
    label: str,
    k: int = 5,
    p: int = 2,
    group: str | None = None,
    cell_rows: int | None = None,
    kept: list[DataFrame] | None = None,
) -> DataFrame:
    """(key, neighbour, distance, label, rank) of the k nearest training rows of every query.

    What is cached on the way is appended to ``kept``, for the caller to release when the result has been read.
    """
    kept = [] if kept is None else kept
    if cell_rows is None:  # wide rows reach most cells: fewer copies of each, a few MB to a block
        cell_rows = 1_000 if len(features) <= PRUNED else 8_000
    g = F.col(group).cast("long") if group else F.lit(-1).cast("long")
    feats = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    xs = [f"x{i}" for i in range(len(features))]
    points = train.select(F.col(key).alias("tk"), g.alias("g"), F.col(label).alias("label"), *feats)
    # copies: the filter on the rank is applied before the shuffle as well, k rows per task and copy
    copies = Window.partitionBy("g", *xs).orderBy("tk")
    points = points.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k).drop("c")
    points = fewer_tasks(points, train.count()).persist()
    kept.append(points)
    asked = queries.select(
        F.col(key).alias("qk"), (g if group else F.lit(-2).cast("long")).alias("g"), *feats
    )

    n = points.count()
    levels = min(int(np.log2(MAX_CELLS)), max(0, int(np.ceil(np.log2(max(n, 1) / cell_rows)))))
    sample = np.zeros((0, len(xs)))
    if levels:
        share = max(SAMPLE_ROWS, SAMPLE_PER_CELL * 2**levels) / n
        rows = points.where(unit_hash("cells", "tk") < share).select(*xs).toArrow()
        sample = as_matrix([rows.column(c).to_numpy() for c in xs])
    cells = Cells(sample, levels)

    @F.pandas_udf(T.IntegerType())
    def cell_of(*cols: pd.Series) -> pd.Series:
        return pd.Series(cells.assign(as_matrix(cols)).astype(np.int32))

    plain, points = points, points.withColumn("cell", cell_of(*xs)).persist()
    asked = asked.withColumn("cell", cell_of(*xs)).persist()
    kept += [points, asked]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.min(c).alias(f"lo_{c}") for c in xs] + [F.max(c).alias(f"hi_{c}") for c in xs]
    boxes = small_rows(points.groupBy("cell").agg(*aggs), MAX_CELLS, "cells")
    ids = np.array([b["cell"] for b in boxes])
    low = np.array([[b[f"lo_{c}"] for c in xs] for b in boxes], dtype=float)
    high = np.array([[b[f"hi_{c}"] for c in xs] for b in boxes], dtype=float)
    sizes = {b["cell"]: b["n"] for b in boxes}

    plain.unpersist()  # the boxes have read all of the points with their cells
    n_asked, endless = asked.count(), F.lit(float("inf")).alias("bound")
    more = asked.select("*", endless)
    if levels:
        # a row for each query and chunk of its cell; the least k-th distance of a chunk bounds that of all points
        own = _search(asked, points, sizes, xs, k, p, cell_rows)
        bound = fewer_tasks(own.groupBy("qk", "g", "cell", *xs).agg(F.min("bound").alias("bound")), n_asked)
        held = F.broadcast(asked.sparkSession.createDataFrame([(c,) for c in sizes], "cell int"))
        bound = bound.unionByName(asked.join(held, "cell", "left_anti").select("*", endless))
        tree = cells.boxes(ids, low, high)
        step = max(1, min(512, BALL_CELLS // (len(xs) << levels)))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def reached(limit: pd.Series, *cols: pd.Series) -> pd.Series:
            x, radius, out = as_matrix(cols), limit.to_numpy() * (1.0 + 1e-9), []
            for a in range(0, len(x), step):
                part = x[a : a + step]
                rows, near = tree.reached(part, radius[a : a + step], p)
                out += np.split(near.astype(np.int32), np.searchsorted(rows, np.arange(1, len(part))))
            return pd.Series(out)

        reach = bound.select("qk", "g", *xs, "bound", reached("bound", *xs).alias("cells")).persist()
        kept.append(reach)
        more = reach.select("qk", "g", *xs, "bound", F.explode("cells").alias("cell"))
    found = _search(more, points, sizes, xs, k, p, cell_rows)
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("qk").orderBy("distance", "neighbour"))
    )
    return ranked.where(F.col("rank") <= k).select(
        F.col("qk").alias(key), "neighbour", "distance", F.col("label").alias(label), "rank"
    )


def _search(asked: DataFrame, points: DataFrame, sizes: dict, xs, k, p, cell_rows) -> DataFrame:
    """The nearest rows within the bound of each (query, cell, chunk); for queries without bounds these, the k-th distance
    or infinity. Both sides of a crowded cell are cut into chunks."""
    spark = asked.sparkSession
    counts = small_rows(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), MAX_CELLS, "cells")
    # many queries are walked in small blocks, and each of their chunks would shuffle the points of the cell again
    per_chunk = cell_rows * (4 if len(xs) <= PRUNED else 1)
    plan = [
        (r["cell"], -(-r["n"] // per_chunk), -(-sizes[r["cell"]] // (2 * cell_rows)))
        for r in counts
        if r["cell"] in sizes
    ]
    chunks = F.broadcast(spark.createDataFrame(plan, "cell int, nq long, nt long"))  # <= MAX_CELLS rows
    bounded = "bound" in asked.columns  # farther rows are not among the nearest of a query
    q = asked.join(chunks, "cell").select(
        "cell",
        F.pmod(F.xxhash64("qk"), F.col("nq")).alias("cq"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("nt") - 1)).alias("ct"),
        "qk",
        "g",
        *(["bound"] if bounded else []),
        *xs,
    )
    t = points.join(chunks, "cell").select(
        "cell",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("cq"),
        F.pmod(F.xxhash64("tk"), F.col("nt")).alias("ct"),
        "tk",
        "g",
        "label",
        *xs,
    )
    types = {f.name: f.dataType for f in [*asked.schema.fields, *points.schema.fields]}
    if not bounded:
        names = ["qk", "g", "cell", *xs]
        kth_schema = T.StructType([*[T.StructField(c, types[c]) for c in names], T.StructField("bound", T.DoubleType())])

        def kth(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
            out = qs[names].assign(bound=np.inf)
            if len(qs) and len(ts):
                r, _, d = nearest(qs, ts)
                last = np.flatnonzero(np.diff(np.append(r, -1)))  # by distance within a query
                full = np.bincount(r, minlength=len(qs)) == k
                far = np.full(len(qs), np.inf)
                far[r[last]] = d[last]
                out["bound"] = np.where(full, far, np.inf)
            return out

    out_schema = T.StructType(
        [
            T.StructField("qk", types["qk"]),
            T.StructField("neighbour", types["tk"]),
            T.StructField("distance", T.DoubleType()),
            T.StructField("label", types["label"]),
        ]
    )

    def nearest(qs, ts):
        return _nearest(
            qs[xs].to_numpy(), ts[xs].to_numpy(), qs["g"].to_numpy(), ts["g"].to_numpy(), ts["tk"].to_numpy(), k, p
        )

    def block(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ts):
            return pd.DataFrame({"qk": [], "neighbour": [], "distance": [], "label": []})
        r, c, d = nearest(qs, ts)
        near = d <= qs["bound"].to_numpy()[r]
        r, c, d = r[near], c[near], d[near]
        return pd.DataFrame(
            {
                "qk": qs["qk"].to_numpy()[r],
                "neighbour": ts["tk"].to_numpy()[c],
                "distance": d,
                "label": ts["label"].to_numpy()[c],
            }
        )

    keys = ["cell", "cq", "ct"]
    cells = q.groupBy(*keys).cogroup(t.groupBy(*keys))
    return cells.applyInPandas(block, out_schema) if bounded else cells.applyInPandas(kth, kth_schema)


def vote(neighbours: DataFrame, key: str, label: str, k_classes: int, weights: str, prefix: str) -> DataFrame:
    """Class shares of the neighbours; ``distance`` weighs by 1/d, exact hits outvote the rest."""
    rows = neighbours
    if weights == "distance":
        nearest = F.min("distance").over(Window.partitionBy(key))
        w = F.when(nearest == 0, (F.col("distance") == 0).cast("double")).otherwise(
            1.0 / F.when(F.col("distance") == 0, F.lit(1.0)).otherwise(F.col("distance"))
        )
        rows = rows.withColumn("__w", w)
    else:
        rows = rows.withColumn("__w", F.lit(1.0))
    sums = rows.groupBy(key).agg(
        *[F.sum(F.when(F.col(label) == c, F.col("__w")).otherwise(0.0)).alias(f"s{c}") for c in range(k_classes)]
    )
    shares = P.renormalize([f"s{c}" for c in range(k_classes)])
    return sums.select(key, *P.named(shares, prefix))


class SvdKnn:
    """The chain as one learner: project, standardise, vote of the nearest training rows."""

    def __init__(self, k, n_components=5, n_neighbors=5, weights="uniform", p=2, metric="minkowski", key="id"):
        self.k, self.n_components, self.n_neighbors, self.weights, self.key = (
            k, n_components, n_neighbors, weights, key,
        )
        self.p = {"euclidean": 2, "manhattan": 1}.get(metric, p)

    def fit(self, df: DataFrame, features, label) -> "SvdKnn":
        require_complete(df, features, label, self.k)
        self.label = label
        self.svd = TruncatedSVD(features, self.n_components).fit(df)
        projected = self.svd.transform(df)
        self.scaler = StandardScaler(self.svd.names).fit(projected)
        self.train = self.scaler.transform(projected).select(self.key, label, *self.svd.names)
        return self

    def score(self, df: DataFrame, prefix: str) -> DataFrame:
        votes = self._votes(df, prefix)
        drop_shuffles(df.sparkSession)
        return df.join(votes, self.key)

    def _votes(self, df: DataFrame, prefix: str) -> DataFrame:
        """(key, shares), written once: what the search cached and shuffled is many times as large, and is released."""
        kept: list[DataFrame] = []
        try:
            asked = self.scaler.transform(self.svd.transform(df)).select(self.key, *self.svd.names)
            near = knn_join(
                asked, self.train, self.key, self.svd.names, self.label, self.n_neighbors, self.p, kept=kept
            )
            return materialize(vote(near, self.key, self.label, self.k, self.weights, prefix), "votes")
        finally:
            for frame in kept:
                frame.unpersist()
