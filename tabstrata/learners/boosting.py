"""Gradient boosting on histograms with a K-class softmax loss (Chen & Guestrin 2016; Ke et al. 2017).

Rows stay on the executors, in blocks of some thousand: a column of bins for each feature, binned once, and one
of margins for each model and class. A tree level is one Spark job: every partition deals its rows to the nodes
and adds up gradient, hessian and weight per (model, class, node, feature, bin), the sums are merged by position,
and the driver, which only ever sees those histograms, picks the splits. Only left children are summed; a
right child is its parent minus the left one. All folds and all classes grow in the same jobs.

Margins are updated lazily in the pass that builds the next root histogram, cached, and
checkpointed to the shared folder every few rounds, so a lost executor costs at most those rounds.

Category columns come in as codes, one bin per code (rare codes past the bin limit share the last
one); their bins are ordered by mean gradient inside a node, or by a fixed target mean, and split
along that order. Bins are quantiles of all rows without labels, shared by the folds.

Deviations from the libraries this stands in for: quantile bins shared by all folds, the diagonal softmax
hessian 2p(1-p) for every preset, no split-score noise and no ordered boosting.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.functions.hashing import unit_hash
from tabstrata.learners.base import (
    ROWS,
    Model,
    block_of,
    joined,
    leaves,
    partial_sums,
    require_complete,
    rows_of,
    softmax_array,
    training_rows,
)
from tabstrata.operators.encode import CategoryCodes, weights_from_counts
from tabstrata.runtime import Steps, at_most, bounded_batches, fewer_tasks, small_rows


EXACT_BIN_ROWS = 500_000
# doubles in the widest histogram level the driver holds at once (1 GB), and in one task (128 MB)
HISTOGRAM_CELLS = 2**27
TASK_CELLS = 2**24
#: Rows to a block: every block adds a histogram to each node that is asked for.
BLOCK = 1 << 15


@dataclass(frozen=True)
class BoostSpec:
    """Everything that defines a boosted model; tuned and final fits share one spec."""

    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    max_leaves: int | None = None  # best-first growth up to this many leaves
    symmetric: bool = False  # one split per level for all nodes
    max_bins: int = 64
    min_child_weight: float = 1e-3  # hessian sum
    min_child_rows: float = 1.0
    gamma: float = 0.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    subsample: float = 1.0
    subsample_every: int = 1
    colsample: float = 1.0
    bagging_temperature: float | None = None  # Bayesian row weights (-ln u) ** T
    class_weight: str | None = None
    category_order: str = "gradient"  # or "target_mean"
    early_stopping: int | None = None  # rounds without improvement on the hold-out
    holdout_fraction: float = 0.1
    seed: int = 42
    checkpoint_every: int = 8


# the presets; search ranges live in plans.registry
DEPTHWISE = BoostSpec()
LEAFWISE = replace(DEPTHWISE, max_leaves=31, max_depth=8, min_child_rows=20.0, reg_lambda=1e-3)
SYMMETRIC = replace(
    DEPTHWISE, symmetric=True, reg_lambda=3.0, bagging_temperature=1.0, early_stopping=100
)
HISTOGRAM = replace(
    DEPTHWISE,
    min_child_rows=20.0,
    reg_lambda=0.0,
    class_weight="balanced",
    category_order="target_mean",
    early_stopping=50,
)


@dataclass
class Tree:
    """Heap-indexed binary tree on bins: node i has children 2i+1 and 2i+2; feature -1 is a leaf."""

    feature: np.ndarray
    left: np.ndarray  # (nodes, bins) True: goes left
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, bins: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, dtype=np.int32), np.zeros((n, bins), dtype=bool), np.zeros(n))

    def route(self, wanted: list[int]) -> "Route":
        """The way to some nodes."""
        above = set()
        for n in wanted:
            while n and (n - 1) // 2 not in above:
                n = (n - 1) // 2
                above.add(n)
        return Route.of(above, wanted, lambda n: (self.feature[n], self.left[n], 2 * n + 1))

    def compact(self) -> "CompactTree":
        """Only reachable nodes, level by level, with the bin masks as bits."""
        order, at = [0], 0
        while at < len(order):
            n = order[at]
            if self.feature[n] >= 0:
                order += [2 * n + 1, 2 * n + 2]
            at += 1
        place = {n: i for i, n in enumerate(order)}
        child = np.array([place.get(2 * n + 1, 0) if self.feature[n] >= 0 else 0 for n in order], dtype=np.int32)
        bits = np.packbits(self.left[order], axis=1)
        return CompactTree(self.feature[order], child, bits, self.value[order])


@dataclass
class CompactTree:
    """A finished tree: the children of node i are child[i] (left) and child[i] + 1."""

    feature: np.ndarray
    child: np.ndarray
    bits: np.ndarray  # (nodes, bins / 8) packed: goes left
    value: np.ndarray

    def goes_left(self, at, b) -> np.ndarray:
        return (self.bits[at, b >> 3] >> (7 - (b & 7))) & 1 == 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        return leaves(self.feature, self.child, np.unpackbits(self.bits, axis=1) == 0, bins)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]

    def route(self) -> "Route":
        """The way to all leaves."""
        inner = self.feature >= 0
        masks = np.unpackbits(self.bits, axis=1).astype(bool)
        return Route.of(np.flatnonzero(inner), np.flatnonzero(~inner), lambda n: (self.feature[n], masks[n], self.child[n]))


@dataclass
class Route:
    """Splits on the way to some nodes, each after the one above it: (node, feature, goes left, left, right), a
    child being -1 where no way leads on. Rows are dealt from node to node, so that a split costs a look-up for
    each row that reaches it, and rows that reach none of the nodes are dropped where they part."""

    steps: list[tuple]
    wanted: list[int]

    @classmethod
    def of(cls, above, wanted, split) -> "Route":
        ways, steps = {int(n) for n in (*above, *wanted)}, []
        for n in sorted(int(n) for n in above):  # children have greater numbers
            f, left, child = split(n)
            ends = (int(c) if c in ways else -1 for c in (child, child + 1))
            steps.append((n, int(f), left, *ends))
        return cls(steps, [int(n) for n in wanted])

    def rows(self, bins: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
        """Those of ``rows`` that reach each of the nodes."""
        at = {0: rows}
        for n, f, goes_left, left, right in self.steps:
            here = at.pop(n)
            go = goes_left[bins[f][here]]
            if left >= 0:
                at[left] = here[go]
            if right >= 0:
                at[right] = here[~go]
        return [at[n] for n in self.wanted]


class LeafTree:
    """A tree grown leaf by leaf: the frontier by gain, and splits looked at ahead of their turn.

    Splits do not influence each other, so the children of several leaves may be summed up in one job; which
    splits belong to the tree is decided by taking, one at a time, the leaf of largest gain. Of splits that
    were looked at in vain there are at most as many as the tree has in the end.
    """

    def __init__(self):
        self.feature, self.left, self.child, self.value = [-1], [None], [0], [0.0]
        self.heap, self.depth = [0], [0]  # path from the root, which decides equal gains
        self.sums: dict[int, np.ndarray] = {}  # histograms of leaves
        self.found: dict[int, tuple] = {}  # (gain, feature, goes left) of nodes that can be split
        self.looked = 0  # splits whose children have been summed up
        self.chosen: list[int] = []

    def split(self, n: int, values: tuple[float, float]) -> int:
        """Makes the children of ``n``; returns the left one, the right one follows it."""
        _, f, left = self.found[n]
        at = len(self.feature)
        self.feature[n], self.left[n], self.child[n] = f, left, at
        self.feature += [-1, -1]
        self.left += [None, None]
        self.child += [0, 0]
        self.value += list(values)
        self.heap += [2 * self.heap[n] + 1, 2 * self.heap[n] + 2]
        self.depth += [self.depth[n] + 1] * 2
        return at

    def wanted(self, max_leaves: int) -> list[int]:
        """Leaves whose children are to be summed up next; none when the tree is complete."""
        self.chosen, frontier = [], {0} & set(self.found)
        rank = lambda n: (self.found[n][0], -self.heap[n])
        while frontier and len(self.chosen) < max_leaves - 1:
            n = max(frontier, key=rank)
            open_ = self.feature[n] < 0
            if open_ and len(self.chosen) < max_leaves - 2:
                break
            frontier.remove(n)
            self.chosen.append(n)
            if not open_:
                frontier |= {self.child[n], self.child[n] + 1} & set(self.found)
        else:
            return []
        missing = max_leaves - 1 - len(self.chosen)
        some = max(1, min(missing, 2 * (max_leaves - 1) - self.looked - missing))
        # leaves whose turn may come next, then those below splits that were looked at ahead
        open_ = sorted((n for n in self.found if self.feature[n] < 0), key=lambda n: (n in frontier, rank(n)), reverse=True)
        return open_[:some]

    def route(self, wanted: list[int]) -> Route:
        """The way to some nodes."""
        parent = {c + side: n for n, c in enumerate(self.child) if self.feature[n] >= 0 for side in (0, 1)}
        above = set()
        for n in wanted:
            while n and parent[n] not in above:
                n = parent[n]
                above.add(n)
        return Route.of(above, wanted, lambda n: (self.feature[n], self.left[n], self.child[n]))

    def compact(self) -> "CompactTree":
        """Nodes below the chosen splits only, level by level."""
        chosen = set(self.chosen)
        order, at = [0], 0
        while at < len(order):
            n = order[at]
            if n in chosen and self.feature[n] >= 0:
                order += [self.child[n], self.child[n] + 1]
            at += 1
        place = {n: i for i, n in enumerate(order)}
        inner = [n in chosen and self.feature[n] >= 0 for n in order]
        width = next((len(x) for x in self.left if x is not None), 8)
        bits = np.array([self.left[n] if k else np.zeros(width, bool) for n, k in zip(order, inner)])
        return CompactTree(
            np.array([self.feature[n] if k else -1 for n, k in zip(order, inner)], dtype=np.int32),
            np.array([place[self.child[n]] if k else 0 for n, k in zip(order, inner)], dtype=np.int32),
            np.packbits(bits, axis=1),
            np.array([self.value[n] for n in order]),
        )


@dataclass
class Binner:
    """Quantile cuts for numbers (bin = count of cuts below x) and codes for categories."""

    numeric: list[str]
    categories: list[str]
    max_bins: int
    cuts: dict = field(default_factory=dict)
    codes: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Binner":
        """Exact quantiles up to EXACT_BIN_ROWS rows, a mergeable sketch of all rows beyond."""
        # one text: thousands of literals made one by one would keep the driver busy for seconds
        points = f"array({', '.join(f'{i / self.max_bins!r}D' for i in range(1, self.max_bins))})"
        if self.numeric:
            call = f"percentile({{}}, {points})"
            if not at_most(df, EXACT_BIN_ROWS):
                call = f"percentile_approx({{}}, {points}, {10 * self.max_bins})"
            aggs = [F.expr(call.format(f"`{c}`")).alias(c) for c in self.numeric]
            row = df.agg(*aggs).first()
            self.cuts = {c: np.unique(np.array(row[c], dtype=float)) for c in self.numeric}
        self.codes = {c: CategoryCodes.fit(df, c, self.max_bins - 1) for c in self.categories}
        return self

    def subset(self, numeric: list[str]) -> "Binner":
        """The same bins for some of the numeric columns."""
        return Binner(list(numeric), [], self.max_bins, {c: self.cuts[c] for c in numeric}, {})

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.categories)

    @property
    def inputs(self) -> list[str]:
        return self.numeric + [f"__code_{c}" for c in self.categories]

    def encode_categories(self, df: DataFrame) -> DataFrame:
        for c in self.categories:
            df = self.codes[c].encode(df, f"__code_{c}")
        return df

    def pack(self, *columns) -> np.ndarray:
        out = np.empty((len(columns[0]), self.width), dtype=np.uint8)
        for i, c in enumerate(self.numeric):
            x = np.asarray(columns[i], dtype=np.float64)
            # missing numbers share the first bin
            out[:, i] = np.searchsorted(self.cuts[c], np.where(np.isnan(x), -np.inf, x), side="left")
        for i in range(len(self.categories)):
            code = np.asarray(columns[len(self.numeric) + i])
            out[:, len(self.numeric) + i] = np.minimum(code, self.max_bins - 1)
        return out


def _unpack(column: pd.Series, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), width)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from row hashes and a salt (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class BoostedModel(Model):
    def __init__(self, binner: Binner, k: int, base: np.ndarray, trees: list[list[CompactTree]]):
        self.binner, self.k, self.base, self.trees = binner, k, base, trees
        self.features = binner.inputs

    def prepare(self, df):
        return self.binner.encode_categories(df)

    def predict_array(self, x):
        bins = self.binner.pack(*x.T)
        m = np.tile(self.base, (len(x), 1))
        for per_class in self.trees:
            for c, tree in enumerate(per_class):
                m[:, c] += tree.predict(bins)
        return softmax_array(m)


@dataclass(frozen=True)
class _Booster:
    """What a task needs besides the trees: shapes, folds, weights. Small and picklable."""

    spec: BoostSpec
    k: int
    width: int
    bins: int
    held: tuple
    weights: np.ndarray  # (models, K)
    base: np.ndarray  # (models, K)

    def names(self) -> list[str]:
        """Columns of a block: bins by feature, margins by model and class, and what a row brings along."""
        bins = [f"b{f}" for f in range(self.width)]
        return bins + [f"m{i}" for i in range(len(self.held) * self.k)] + ["y", "fold", "h", "out"]

    def block(self, bins, margins, rest) -> pa.RecordBatch:
        return block_of(pa.RecordBatch.from_arrays([*map(pa.array, (*bins, *margins, *rest))], names=self.names()))

    def rows(self, batch: pa.RecordBatch):
        """Bins by feature, margins by model and class, and (label, fold, hash, hold-out)."""
        columns = [c.to_numpy() for c in batch.columns]
        last = self.width + len(self.held) * self.k
        return columns[: self.width], columns[self.width : last], columns[last:]

    def row_weights(self, y, fold, h, out, round_: int) -> np.ndarray:
        """(n, models): fold mask x class weight x bagging; hold-out rows get zero."""
        mask = training_rows(fold, len(y), list(self.held)).astype(float)
        w = mask * self.weights[:, y].T
        w[out] = 0.0
        h = h.view(np.uint64)
        s = self.spec
        if s.subsample < 1.0:
            w *= (_mix(h, s.seed + 1 + round_ // s.subsample_every) < s.subsample)[:, None]
        if s.bagging_temperature:
            w *= ((-np.log(_mix(h, s.seed + 100_003 + round_))) ** s.bagging_temperature)[:, None]
        return w


class HistogramBooster:
    """K-class boosting; ``fit_folds`` trains the fold models and, unless left out, the full model together."""

    folds_only = True

    def __init__(self, k: int, spec: BoostSpec, numeric: list[str], categories: list[str] = (), key="id"):
        self.k, self.spec, self.key = k, spec, key
        self.numeric, self.categories = list(numeric), list(categories)

    def fit(self, df: DataFrame, label: str) -> BoostedModel:
        return self.fit_folds(df, label, None, 0)[-1]

    def fit_folds(self, df: DataFrame, label: str, fold: str | None, k_folds: int, whole: bool = True) -> list[BoostedModel]:
        spec, k = self.spec, self.k
        require_complete(df, self.numeric, label, k)  # a missing category is a category
        bins = min(spec.max_bins, 256)
        binner = Binner(self.numeric, self.categories, bins).fit(df)
        held = tuple(([*range(k_folds)] if fold else []) + ([-1] if whole or not fold else []))
        m = len(held)
        fold_col = F.col(fold).cast("int") if fold else F.lit(-2)
        base, weights, rows = self._start(df, label, fold_col, held)
        booster = _Booster(spec, k, binner.width, bins, held, weights, base)
        coded = binner.encode_categories(df)

        def pack(batches):
            for batch in joined(batches, BLOCK):
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                y, part, h, out = columns[binner.width :]
                margins = [np.full(len(y), start) for start in base.ravel()]
                rest = (y, part, h, out.astype(np.uint8))
                yield booster.block(np.ascontiguousarray(binner.pack(*columns[: binner.width]).T), margins, rest)

        out = unit_hash(f"{spec.seed}|holdout", self.key) < spec.holdout_fraction
        state = coded.select(
            *[F.col(c) for c in binner.inputs],
            F.col(label).cast("int").alias("__y"),
            fold_col.alias("__fold"),
            F.xxhash64(F.col(self.key)).alias("__h"),
            (out if spec.early_stopping else F.lit(False)).alias("__out"),
        )
        state = fewer_tasks(bounded_batches(state), rows).mapInArrow(pack, f"{ROWS} binary").persist()
        order = self._fixed_order(state, booster) if spec.category_order == "target_mean" else None

        trees: list[list[list[CompactTree]]] = [[] for _ in held]
        best, best_round, stopped = np.full(m, np.inf), np.zeros(m, dtype=int), np.zeros(m, dtype=bool)
        last, steps = None, Steps(df.sparkSession, "boosting")
        for r in range(spec.rounds + (1 if spec.early_stopping else 0)):
            grown, loss = self._grow(state, booster, r, order, only_loss=r == spec.rounds)
            if last is not None:  # its margins went on when the first pass over these filled their cache
                last.unpersist()
            last = state
            if spec.early_stopping:
                better = (loss < best) & ~stopped
                best_round = np.where(better, r, best_round)
                best = np.where(better, loss, best)
                stopped |= r - best_round >= spec.early_stopping
                if stopped.all() or r == spec.rounds:
                    break
            grown = [[t.compact() for t in per_class] for per_class in grown]
            for i in range(m):
                trees[i].append(grown[i])
            if r + 1 == spec.rounds and not spec.early_stopping:
                break  # nobody reads the margins after the last round
            nxt = _advance(state, booster, grown)
            state = steps.write(nxt) if (r + 1) % spec.checkpoint_every == 0 else nxt.persist()
        state.unpersist()
        if last is not None:
            last.unpersist()
        steps.close()
        if spec.early_stopping:
            trees = [t[: max(int(b), 1)] for t, b in zip(trees, best_round)]
        return [
            BoostedModel(binner, k, base[i], trees[i]) for i in range(m)
        ]

    # pieces -----------------------------------------------------------------------------------
    def _start(self, df, label, fold_col, held):
        """Log prior and class weights of every model from one (fold, class) count, and the number of rows."""
        counts = df.groupBy(fold_col.alias("f"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
        n, rows = np.zeros((len(held), self.k)), 0
        for r in small_rows(counts, 100_000, "fold and class counts"):
            rows += r["n"]
            for i, j in enumerate(held):
                if r["f"] != j:
                    n[i, r["y"]] += r["n"]
        weights = np.zeros_like(n)
        for i in range(len(held)):
            w = weights_from_counts({c: v for c, v in enumerate(n[i]) if v > 0}, self.spec.class_weight)
            weights[i] = [w.get(c, 0.0) for c in range(self.k)]
        mass = np.maximum(n * weights, 1e-12)
        return np.log(mass / mass.sum(axis=1, keepdims=True)), weights, rows

    def _fixed_order(self, state, b: _Booster) -> np.ndarray:
        """(models, category, bins) rank of every code by its mean encoded label in the training rows."""
        n_cat, first = len(self.categories), len(self.numeric)
        m = len(b.held)

        def add(batch, acc):
            view = acc.reshape(m, n_cat, b.bins, 2)
            bins, _, (y, part, _, _) = b.rows(batch)
            mask = training_rows(part, len(y), list(b.held))
            for i in range(m):
                for c in range(n_cat):
                    code = bins[first + c][mask[:, i]]
                    view[i, c, :, 0] += np.bincount(code, minlength=b.bins)
                    view[i, c, :, 1] += np.bincount(code, y[mask[:, i]], minlength=b.bins)

        if not n_cat:
            return None
        sums = partial_sums(state, [ROWS], add, m * n_cat * b.bins * 2, True)
        sums = sums.reshape(m, n_cat, b.bins, 2)
        prior = sums[..., 1].sum(axis=2, keepdims=True) / np.maximum(sums[..., 0].sum(axis=2, keepdims=True), 1)
        mean = (sums[..., 1] + 10.0 * prior) / (sums[..., 0] + 10.0)
        return np.argsort(np.argsort(mean, axis=2, kind="stable"), axis=2, kind="stable")

    def _features(self, round_: int) -> np.ndarray:
        """Columns offered to this round's trees."""
        d = len(self.numeric) + len(self.categories)
        if self.spec.colsample >= 1.0:
            return np.ones(d, dtype=bool)
        u = _mix(np.arange(1, d + 1, dtype=np.uint64), self.spec.seed * 7_919 + round_)
        keep = np.zeros(d, dtype=bool)
        keep[np.argsort(u)[: max(1, round(self.spec.colsample * d))]] = True
        return keep

    def _grow(self, state, b: _Booster, round_, order, only_loss=False):
        """One tree per (model, class), level by level; also the hold-out loss of each model.

        All trees share their jobs unless the histograms of a deep level would outgrow the driver;
        then the trees are grown in groups.
        """
        spec, k, m = self.spec, self.k, len(b.held)
        leafwise = spec.max_leaves and not spec.symmetric
        empty = LeafTree if leafwise else lambda: Tree.empty(spec.max_depth, b.bins)
        trees = [[empty() for _ in range(k)] for _ in range(m)]
        roots = [(i, c, 0) for i in range(m) for c in range(k)]
        widest = spec.max_leaves if leafwise else 2 ** max(spec.max_depth - 1, 0)
        size = max(1, HISTOGRAM_CELLS // (widest * b.width * b.bins * 3))
        grow = self._grow_leaves if leafwise else self._grow_group
        loss = None
        for at in range(0, len(roots), size):
            found = grow(state, b, round_, order, trees, roots[at : at + size], only_loss)
            loss = found if loss is None else loss
            if only_loss:
                break
        return trees, loss

    def _leaf(self, sums: np.ndarray) -> float:
        """Shrunken leaf value from (gradient, hessian, rows)."""
        g, h = sums[0], sums[1] + self.spec.reg_lambda
        soft = np.sign(g) * max(abs(g) - self.spec.reg_alpha, 0.0)
        return -self.spec.learning_rate * soft / h if h > 0 else 0.0

    def _split(self, tree: Tree, n: int, h: np.ndarray, f: int, left: np.ndarray) -> None:
        """Records a split; the children's sums are already in the parent's histogram."""
        tree.feature[n], tree.left[n] = f, left
        tree.value[2 * n + 1] = self._leaf(h[f][left].sum(axis=0))
        tree.value[2 * n + 2] = self._leaf(h[f][~left].sum(axis=0))

    def _asked(self, state, b: _Booster, round_, trees, asked):
        """Histograms of the asked nodes, as many to a job as a task can sum side by side, and the first job's losses."""
        width = max(1, TASK_CELLS // (b.width * b.bins * 3))
        hist, extra = [], None
        for at in range(0, len(asked), width):
            sums, found = self._histograms(state, b, round_, trees, asked[at : at + width])
            hist += list(sums)
            extra = found if at == 0 else extra
        return hist, extra

    def _grow_leaves(self, state, b: _Booster, round_, order, trees, roots, only_loss):
        """Best-first growth of some trees, several leaves of each to a job."""
        spec, offered = self.spec, self._features(round_)
        hist, extra = self._asked(state, b, round_, trees, roots)
        loss = np.where(extra[:, 1] > 0, extra[:, 0] / np.maximum(extra[:, 1], 1e-300), np.inf)
        if only_loss:
            return loss

        def look(i, tree, n, h):
            tree.sums[n] = h
            if tree.depth[n] < spec.max_depth:
                found = self._best_split(h[None], offered, None if order is None else order[i])
                if found is not None:
                    tree.found[n] = found

        def values(h, f, left):
            return self._leaf(h[f][left].sum(axis=0)), self._leaf(h[f][~left].sum(axis=0))

        for (i, c, n), h in zip(roots, hist):
            trees[i][c].value[n] = self._leaf(h[0].sum(axis=0))
            look(i, trees[i][c], n, h)
        while True:
            asked, again = [], False
            for i, c, _ in roots:
                tree = trees[i][c]
                for n in tree.wanted(spec.max_leaves):
                    left = tree.split(n, values(tree.sums[n], *tree.found[n][1:]))
                    again = True
                    if tree.depth[left] < spec.max_depth:  # else its children are leaves whatever they hold
                        tree.looked += 1
                        asked.append((i, c, left, n))
            if not again:
                break
            asked.sort()
            for (i, c, left, n), h in zip(asked, self._asked(state, b, round_, trees, [a[:3] for a in asked])[0]):
                tree = trees[i][c]
                look(i, tree, left + 1, tree.sums.pop(n) - h)
                look(i, tree, left, h)
        for i, c, _ in roots:
            tree = trees[i][c]
            for n in tree.chosen:
                if tree.feature[n] < 0:  # the last split needs no look at its children
                    tree.split(n, values(tree.sums[n], *tree.found[n][1:]))
            tree.sums = {}
        return loss

    def _grow_group(self, state, b: _Booster, round_, order, trees, open_nodes, only_loss):
        spec, m = self.spec, len(b.held)
        offered = self._features(round_)
        parents = None  # histograms of the previous level, keyed by (model, class, node)
        loss = np.full(m, np.inf)
        for depth in range(spec.max_depth):
            asked = open_nodes if depth == 0 else [n for n in open_nodes if n[2] % 2 == 1]
            if not asked:
                break
            hist, extra = self._asked(state, b, round_, trees, asked)
            if depth == 0:
                loss = np.where(extra[:, 1] > 0, extra[:, 0] / np.maximum(extra[:, 1], 1e-300), np.inf)
                if only_loss:
                    return loss
            level = dict(zip(asked, hist))
            if depth == 0:
                for (i, c, n), h in level.items():
                    trees[i][c].value[n] = self._leaf(h[0].sum(axis=0))
            else:
                for i, c, n in [x for x in open_nodes if x[2] % 2 == 0]:
                    level[(i, c, n)] = parents[(i, c, (n - 1) // 2)] - level[(i, c, n - 1)]
            if spec.symmetric:
                nxt = self._split_symmetric(level, trees, offered, order)
            else:
                nxt = []
                for (i, c, n), h in sorted(level.items(), key=lambda e: e[0]):
                    found = self._best_split(h[None], offered, None if order is None else order[i])
                    if found is not None:
                        self._split(trees[i][c], n, h, *found[1:])
                        nxt += [(i, c, 2 * n + 1), (i, c, 2 * n + 2)]
            parents, open_nodes = level, nxt
        return loss

    def _histograms(self, state, b: _Booster, round_, trees, asked):
        """(asked, feature, bin, 3) sums of gradient, hessian and rows, plus (models, 2) hold-out loss."""
        k, m, d, nb = b.k, len(b.held), b.width, b.bins
        per_tree = {}
        for pos, (i, c, n) in enumerate(asked):  # nodes of a tree stand next to each other
            per_tree.setdefault((i, c), []).append((n, pos))
        shape = (len(asked), d, nb, 3)
        size = int(np.prod(shape))
        root = asked[0][2] == 0
        routes = {(i, c): trees[i][c].route([n for n, _ in nodes]) for (i, c), nodes in per_tree.items()}
        first = {key: nodes[0][1] for key, nodes in per_tree.items()}

        def add(batch, acc):
            bins, margins, (y, part, h, out) = b.rows(batch)
            out = out.astype(bool)
            w_all = b.row_weights(y, part, h, out, round_)
            view = acc[:size].reshape(shape)
            for i in range(m):
                own = [(c, routes[i, c]) for c in range(k) if (i, c) in routes]
                if not (own or root):
                    continue
                p = np.stack(margins[i * k : (i + 1) * k])
                p = np.exp(p - p.max(axis=0))
                p /= p.sum(axis=0)
                if root:
                    aside = out & (part != b.held[i])
                    if aside.any():
                        cost = b.weights[i][y[aside]]
                        loss = -np.log(np.maximum(p[y[aside], np.flatnonzero(aside)], 1e-15))
                        acc[size + 2 * i] += (loss * cost).sum()
                        acc[size + 2 * i + 1] += cost.sum()
                w = np.ascontiguousarray(w_all[:, i])
                rows = np.flatnonzero(w > 0)
                if not len(rows):
                    continue
                cells = {}
                for c, route in own:
                    reached = route.rows(bins, rows)
                    nodes, here = len(reached), np.concatenate(reached)
                    if not len(here):
                        continue
                    if route.steps or not cells:  # at the root all classes have the same rows
                        base = np.repeat(np.arange(nodes) * nb, [len(r) for r in reached])
                        cells = {f: base + bins[f][here] for f in range(d)}
                        counts = {f: np.bincount(cells[f], minlength=nodes * nb) for f in range(d)}
                    pc, wc = p[c][here], w[here]
                    g = (pc - (y[here] == c)) * wc
                    h_ = np.maximum(2.0 * pc * (1.0 - pc), 1e-16) * wc
                    at = first[i, c]
                    for f in range(d):
                        for s, found in enumerate((
                            np.bincount(cells[f], g, nodes * nb), np.bincount(cells[f], h_, nodes * nb), counts[f]
                        )):
                            view[at : at + nodes, f, :, s] += found.reshape(nodes, nb)

        flat = partial_sums(state, [ROWS], add, size + 2 * m, True)
        return flat[:size].reshape(shape), flat[size:].reshape(m, 2)

    def _scores(self, h: np.ndarray, order_i):
        """Gains of all ordered cuts: h (nodes, d, bins, 3) -> gain (nodes, d, bins), bin order."""
        s = self.spec
        nodes, d, nb, _ = h.shape
        order = np.broadcast_to(np.arange(nb), (nodes, d, nb)).copy()
        first = len(self.numeric)
        for j in range(len(self.categories)):
            if order_i is not None:
                order[:, first + j] = np.argsort(order_i[j], kind="stable")
            else:
                merged = h[:, first + j].sum(axis=0)
                ratio = np.where(merged[:, 2] > 0, merged[:, 0] / (merged[:, 1] + s.reg_lambda + 1e-12), np.inf)
                order[:, first + j] = np.argsort(ratio, kind="stable")
        o = np.take_along_axis(h, order[..., None], axis=2).cumsum(axis=2)
        total = o[:, :, -1:, :]

        def value(x):
            soft = np.sign(x[..., 0]) * np.maximum(np.abs(x[..., 0]) - s.reg_alpha, 0.0)
            return soft**2 / np.maximum(x[..., 1] + s.reg_lambda, 1e-12)

        right = total - o
        gain = 0.5 * (value(o) + value(right) - value(total)) - s.gamma
        ok = (
            (o[..., 2] >= s.min_child_rows)
            & (right[..., 2] >= s.min_child_rows)
            & (o[..., 1] >= s.min_child_weight)
            & (right[..., 1] >= s.min_child_weight)
        )
        return gain, ok, order

    def _best_split(self, h, offered, order_i):
        gain, ok, order = self._scores(h, order_i)
        g = np.where(ok, gain, -np.inf)[0]
        g[~offered] = -np.inf
        g = np.round(g, 9)  # equal up to summation order: the first (feature, bin) wins
        f, cut = np.unravel_index(int(np.argmax(g)), g.shape)
        if not g[f, cut] > 1e-9:
            return None
        left = np.zeros(h.shape[2], dtype=bool)
        left[order[0, f, : cut + 1]] = True
        return float(g[f, cut]), int(f), left

    def _split_symmetric(self, level, trees, offered, order):
        """The same (feature, cut) for all nodes of a tree level, by the summed gain."""
        nxt, per_tree = [], {}
        for (i, c, n), h in level.items():
            per_tree.setdefault((i, c), []).append((n, h))
        for (i, c), nodes in per_tree.items():
            h = np.stack([x for _, x in nodes])
            gain, ok, o = self._scores(h, None if order is None else order[i])
            g = np.where(ok, gain, 0.0).sum(axis=0)
            g[~offered | ~ok.any(axis=0).any(axis=1)] = -np.inf
            g = np.round(g, 9)
            f, cut = np.unravel_index(int(np.argmax(g)), g.shape)
            if not g[f, cut] > 1e-9:
                continue
            left = np.zeros(h.shape[2], dtype=bool)
            left[o[0, f, : cut + 1]] = True
            for n, own in nodes:
                self._split(trees[i][c], n, own, int(f), left)
                nxt += [(i, c, 2 * n + 1), (i, c, 2 * n + 2)]
        return nxt


def _advance(state: DataFrame, b: _Booster, grown) -> DataFrame:
    """Margins after this round's trees."""
    routes = [(t.route(), t.value) for per in grown for t in per]

    def task(batches):
        for batch in batches:
            for rows in rows_of(batch):
                bins, margins, rest = b.rows(rows)
                every, moved = np.arange(rows.num_rows), []
                for (route, value), margin in zip(routes, margins):
                    margin = margin.copy()
                    for n, reached in zip(route.wanted, route.rows(bins, every)):
                        margin[reached] += value[n]
                    moved.append(margin)
                yield b.block(bins, moved, rest)

    return state.mapInArrow(task, f"{ROWS} binary")
