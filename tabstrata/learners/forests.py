"""Random forests (Breiman 2001) and extremely randomised trees (Geurts et al. 2006) on shared histograms.

All trees of all folds grow together, one level per job. Rows stay on the executors, in blocks of tens of
thousands: a column of bins for each feature. A pass deals the rows of a block to the nodes of a tree and adds up
class weights and rows per (model, tree, node, candidate feature, bin), merged by position, and the driver, which
only sees these sums, chooses the splits. A forest tries every cut of its
candidates; extra trees try one cut per candidate, drawn uniformly between the least and the greatest bin that
the node holds. Draws are hashes of (seed, tree, node, feature), and the bootstrap weight of a row is a
Poisson number drawn from (seed, tree, hash of the row), so nothing depends on partitioning or on the order
in which nodes are grown. Where none of a node's candidates can be split, the next ones are tried.

Nodes hold at least ``min_samples_leaf`` rows and are split from ``min_samples_split`` rows on, rows of the
bootstrap sample counting once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.learners.base import ROWS, Model, block_of, feature_sets, joined, leaves, partial_sums, require_complete, training_rows
from tabstrata.learners.boosting import TASK_CELLS, Binner, Route, _mix
from tabstrata.operators.encode import weights_from_counts
from tabstrata.runtime import bounded_batches, small_rows

#: Cumulative probabilities of Poisson(1); a row is drawn 0, 1, 2, ... times.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
#: Nodes whose splits are searched together on the driver.
SEARCHED = 2000
#: Rows to a block: every block adds a histogram to each node that is asked for, however few of its rows are there.
BLOCK = 1 << 16


def draw(seed: int, tree: int, node: int, features: np.ndarray) -> np.ndarray:
    """A uniform number per feature from (seed, tree, node, feature)."""
    path = np.full(1, (seed * 1_000_003 + tree) % 2**63, np.uint64)
    h = (_mix(path, node + 1) * 2.0**53).astype(np.uint64)
    return _mix(np.uint64(1) + features.astype(np.uint64) + h * np.uint64(4096), seed + 17)


def candidates(max_features, d: int) -> int:
    """Number of features tried at a node: sqrt, log2, a share, or all."""
    if max_features == "sqrt":
        return max(1, int(math.sqrt(d)))
    if max_features == "log2":
        return max(1, int(math.log2(d)))
    return d if max_features is None else max(1, int(max_features * d))


class GrowingTree:
    """Nodes in the order they were made; the children of node n are child[n] and child[n] + 1."""

    def __init__(self):
        self.feature, self.cut, self.child, self.value, self.heap = [-1], [0], [0], [None], [0]

    def arrays(self):
        return np.array(self.feature, np.int32), np.array(self.cut, np.uint8), np.array(self.child, np.int32)

    def route(self, wanted: list[int], max_bins: int) -> Route:
        """The way to some nodes."""
        parent = {c + side: n for n, c in enumerate(self.child) if self.feature[n] >= 0 for side in (0, 1)}
        above = set()
        for n in wanted:
            while n and parent[n] not in above:
                n = parent[n]
                above.add(n)
        return Route.of(above, wanted, lambda n: (self.feature[n], np.arange(max_bins) <= self.cut[n], self.child[n]))

    def split(self, n: int, feature: int, cut: int, left, right) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[n], self.cut[n], self.child[n] = feature, cut, at
        self.feature += [-1, -1]
        self.cut += [0, 0]
        self.child += [0, 0]
        self.value += [left, right]
        self.heap += [2 * self.heap[n] + 1, 2 * self.heap[n] + 2]
        return at, at + 1


@dataclass
class PackedTree:
    """A finished tree; feature -1 is a leaf, ``value`` holds the class shares of each node."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, tree: GrowingTree, places: np.ndarray) -> "PackedTree":
        """``places[f]`` is the position of the state's column f among the model's features."""
        feature, cut, child = tree.arrays()
        return cls(np.where(feature >= 0, places[np.maximum(feature, 0)], -1).astype(np.int32), cut, child, np.array(tree.value))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[leaves(self.feature, self.child, np.arange(256) > self.cut[:, None], bins)]


class ForestModel(Model):
    """Trees over the bins of ``binner``: the mean of the class shares of the leaves a row falls in."""

    def __init__(self, binner: Binner, k: int, trees: list[PackedTree]):
        self.binner, self.k, self.trees, self.features = binner, k, trees, binner.inputs

    def predict_array(self, x):
        bins = self.binner.pack(*x.T)
        out = np.zeros((len(x), self.k))
        for tree in self.trees:
            out += tree.predict(bins)
        return out / len(self.trees)


class Forest:
    """Shared grower; ``fit_folds`` trains the fold models and the full model together.

    ``features`` may be one list, or one list for each model (columns encoded for that model).
    """

    random_cuts = False
    feature_lists = True  # each model may have columns of its own

    def __init__(
        self, k, n_estimators=20, max_depth=8, min_samples_leaf=20, max_features="sqrt", criterion="gini",
        bootstrap=True, class_weight=None, min_samples_split=2, max_bins=64, seed=42, key="id",
    ):
        self.__dict__.update({n: v for n, v in locals().items() if n != "self"})

    def fit(self, df: DataFrame, features, label) -> ForestModel:
        return self.fit_folds(df, features, label, None, 0)[-1]

    def fit_folds(self, df: DataFrame, features, label, fold: str | None, k_folds: int) -> list[ForestModel]:
        held = ([*range(k_folds)] if fold else []) + [-1]
        sets = feature_sets(features, len(held))
        columns = list(dict.fromkeys(c for s in sets for c in s))
        require_complete(df, columns, label, self.k)
        binner = Binner(columns, [], self.max_bins).fit(df)
        own = [np.array([columns.index(c) for c in s]) for s in sets]
        key = F.col(self.key) if self.key in df.columns else F.struct(*columns, label)

        names = [f"b{f}" for f in range(len(columns))] + ["y", "fold", "h"]

        def pack(batches):
            for batch in joined(batches, BLOCK):
                *xs, y, part, h = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                arrays = [*np.ascontiguousarray(binner.pack(*xs).T), y, part, h]
                yield block_of(pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names=names))

        rows = df.select(
            *columns,
            F.col(label).cast("int").alias("__y"),
            (F.col(fold).cast("int") if fold else F.lit(-2)).alias("__fold"),
            F.xxhash64(key).alias("__h"),
        )
        state = bounded_batches(rows).mapInArrow(pack, f"{ROWS} binary").persist()
        try:
            trees = self._grow(state, binner, own, held)
        finally:
            state.unpersist()
        out = []
        for i, s in enumerate(sets):
            places = np.zeros(len(columns), np.int64)
            places[own[i]] = np.arange(len(s))
            out.append(ForestModel(binner.subset(s), self.k, [PackedTree.of(t, places) for t in trees[i]]))
        return out

    # growing ------------------------------------------------------------------------------------
    def _grow(self, state: DataFrame, binner: Binner, own, held) -> list[list[GrowingTree]]:
        trees = [[GrowingTree() for _ in range(self.n_estimators)] for _ in held]
        self.tried = candidates(self.max_features, len(own[0]))
        weights = self._class_weights(state, held)
        asked = [(i, t, 0, 0, 0) for i in range(len(held)) for t in range(self.n_estimators)]  # ..., depth, attempt
        most = max(1, TASK_CELLS // (self.tried * self.max_bins * (self.k + 1)))
        subsample = self.class_weight == "balanced_subsample"
        per_tree = {}
        while asked:
            nxt = []
            for low in range(0, len(asked), most):
                some = asked[low : low + most]
                offered = np.array([self._offered(own[i], t, trees[i][t].heap[n], a) for i, t, n, _, a in some])
                sums = self._histograms(state, held, trees, some, offered, len(binner.numeric))
                for at in range(0, len(some), SEARCHED):
                    part, hist = some[at : at + SEARCHED], sums[at : at + SEARCHED]
                    for (i, t, n, d, _), h in zip(part, hist):
                        if d == 0 and (i, t) not in per_tree:
                            per_tree[(i, t)] = self._of_counts(h[0].sum(0)[:-1]) if subsample else weights[i]
                    w = np.array([per_tree[(i, t)] for i, t, *_ in part])
                    nxt += self._split(binner, trees, part, hist, w, offered[at : at + SEARCHED], own)
            asked = nxt
        return trees

    def _class_weights(self, state, held) -> np.ndarray:
        """(models, K) weights from each model's class counts."""

        def add(batch, acc):
            y, mask = batch.column("y").to_numpy(), training_rows(batch.column("fold").to_numpy(), batch.num_rows, held)
            view = acc.reshape(len(held), self.k)
            for i in range(len(held)):
                view[i] += np.bincount(y[mask[:, i]], minlength=self.k)

        n = partial_sums(state, [ROWS], add, len(held) * self.k, True).reshape(len(held), self.k)
        return np.array([self._of_counts(x) for x in n])

    def _of_counts(self, n: np.ndarray) -> np.ndarray:
        w = weights_from_counts({c: v for c, v in enumerate(n) if v > 0} or {0: 1}, self.class_weight)
        return np.array([w.get(c, 0.0) for c in range(self.k)])

    def _offered(self, own: np.ndarray, tree: int, heap: int, attempt: int) -> np.ndarray:
        """Candidate columns of a node: the next ones of its own order of the features at each attempt."""
        order = own[np.argsort(draw(self.seed, tree, heap, np.arange(len(own))), kind="stable")]
        return order[(attempt * self.tried + np.arange(self.tried)) % len(own)]

    def _histograms(self, state, held, trees, asked, offered, width) -> np.ndarray:
        """(asked, candidates, bins, K + 1): bootstrap weight of each class, and rows."""
        k, nb, tried, seed, bootstrap = self.k, self.max_bins, self.tried, self.seed, self.bootstrap
        jobs = {}
        for pos, (i, t, n, *_) in enumerate(asked):  # nodes of a tree stand next to each other
            jobs.setdefault((i, t), []).append((n, pos))
        plans = []
        for (i, t), nodes in jobs.items():
            first, wanted = nodes[0][1], [n for n, _ in nodes]
            plans.append((i, t, trees[i][t].route(wanted, nb), first, offered[first : first + len(nodes)]))
        plans.sort(key=lambda p: p[1])  # a tree's bootstrap weights are drawn once for all models
        shape = (len(asked), tried, nb, k + 1)

        def add(batch, acc):
            columns = [c.to_numpy() for c in batch.columns]
            bins, (y, part, h) = columns[:width], columns[width:]
            mask, h, n = training_rows(part, len(y), held), h.view(np.uint64), len(y)
            own = [np.flatnonzero(mask[:, i]) for i in range(len(held))]
            cells = np.stack(bins).astype(np.int32)  # (bin, class) of each row by feature
            cells *= k
            cells += y
            cells, view, drawn, whole = cells.ravel(), acc.reshape(shape), {}, {}
            for i, t, route, first, columns in plans:
                rows = own[i]
                if bootstrap:
                    if t not in drawn:
                        drawn = {t: np.searchsorted(POISSON, _mix(h, seed * 31 + 7 * t + 1)).astype(float)}
                    rows = rows[drawn[t][rows] > 0]
                root = not (route.steps or bootstrap)  # all trees of a model have the same rows there
                reached = route.rows(bins, rows)
                sizes, nodes = [len(r) for r in reached], len(reached)
                here = np.concatenate(reached)
                if not len(here):
                    continue
                base = np.repeat(np.arange(nodes) * (nb * k), sizes)
                for s in range(tried):
                    key = (i, columns[0, s])
                    if root and key in whole:
                        found = whole[key]
                    else:
                        cell = cells[here + np.repeat(columns[:, s] * n, sizes)] + base
                        found = np.bincount(cell, minlength=nodes * nb * k).reshape(nodes, nb, k)
                        whole |= {key: found} if root else {}
                    spot = view[first : first + nodes, s]
                    spot[..., k] += found.sum(2)
                    if bootstrap:
                        found = np.bincount(cell, drawn[t][here], nodes * nb * k).reshape(nodes, nb, k)
                    spot[..., :k] += found

        return partial_sums(state, [ROWS], add, int(np.prod(shape)), True).reshape(shape)

    def _impurity(self, counts: np.ndarray) -> np.ndarray:
        """Impurity times weight of the class weights in the last axis."""
        total = counts.sum(-1)
        if self.criterion == "gini":
            return total - (counts**2).sum(-1) / np.maximum(total, 1e-300)
        share = counts / np.maximum(total, 1e-300)[..., None]
        return -(counts * np.log(np.maximum(share, 1e-300))).sum(-1)

    def _split(self, binner, trees, asked, hist, weights, offered, own) -> list:
        """Splits the asked nodes in place; returns the nodes to ask next."""
        rows, counts = hist[..., -1], hist[..., :-1] * weights[:, None, None, :]
        left_rows, left = rows.cumsum(2), counts.cumsum(2)
        total_rows, total = left_rows[:, :1, -1:], left[:, :1, -1:]
        ok = (left_rows >= self.min_samples_leaf) & (total_rows - left_rows >= self.min_samples_leaf)
        if self.random_cuts:
            ok &= self._drawn_cuts(binner, trees, asked, rows, offered)
        gain = self._impurity(total) - self._impurity(left) - self._impurity(total - left)
        gain = np.where(ok, np.round(gain, 9), -np.inf)
        flat = gain.reshape(len(asked), -1)
        best, nxt = flat.argmax(1), []
        for p, (i, t, n, depth, attempt) in enumerate(asked):
            tree = trees[i][t]
            if depth == 0 and tree.value[0] is None:
                tree.value[0] = self._share(total[p, 0, 0])
                if not self._open(total_rows[p, 0, 0], total[p, 0, 0], 0):
                    continue
            if not np.isfinite(flat[p, best[p]]):
                if (attempt + 1) * self.tried < len(own[i]):
                    nxt.append((i, t, n, depth, attempt + 1))
                continue
            s, cut = divmod(int(best[p]), self.max_bins)
            sums = left[p, s, cut], total[p, 0, 0] - left[p, s, cut]
            sizes = left_rows[p, s, cut], total_rows[p, 0, 0] - left_rows[p, s, cut]
            made = tree.split(n, int(offered[p, s]), cut, self._share(sums[0]), self._share(sums[1]))
            nxt += [(i, t, c, depth + 1, 0) for c, r, v in zip(made, sizes, sums) if self._open(r, v, depth + 1)]
        return sorted(nxt, key=lambda a: (a[0], a[1], a[2]))

    def _drawn_cuts(self, binner, trees, asked, rows, offered) -> np.ndarray:
        """True at the one cut drawn for each (node, candidate)."""
        out = np.zeros(rows.shape, bool)
        held = rows > 0
        low, high = held.argmax(2), rows.shape[2] - 1 - held[:, :, ::-1].argmax(2)
        for p, (i, t, n, *_) in enumerate(asked):
            u = draw(self.seed + 1, t, trees[i][t].heap[n], offered[p])
            for s, f in enumerate(offered[p]):
                if low[p, s] < high[p, s]:
                    edges = binner.cuts[binner.numeric[f]][low[p, s] : high[p, s]]
                    at = int(np.searchsorted(edges, edges[0] + u[s] * (edges[-1] - edges[0]), side="right")) - 1
                    out[p, s, low[p, s] + max(at, 0)] = True
        return out

    def _open(self, rows: float, counts: np.ndarray, depth: int) -> bool:
        least = max(self.min_samples_split, 2 * self.min_samples_leaf, 2)
        return depth < self.max_depth and rows >= least and (counts > 0).sum() > 1

    def _share(self, counts: np.ndarray) -> np.ndarray:
        total = counts.sum()
        return counts / total if total > 0 else np.full(self.k, 1.0 / self.k)


class RandomForest(Forest):
    """Bootstrapped trees, every cut of the candidates; ``log_loss`` means entropy."""


class ExtraTrees(Forest):
    """All rows for every tree, one random cut per candidate."""

    random_cuts = True

    def __init__(
        self, k, n_estimators=20, max_depth=8, min_samples_leaf=20, max_features=0.4, criterion="gini",
        class_weight="balanced", min_samples_split=2, max_bins=256, seed=42, key="id",
    ):
        super().__init__(
            k, n_estimators, max_depth, min_samples_leaf, max_features, criterion, False, class_weight,
            min_samples_split, max_bins, seed, key,
        )
