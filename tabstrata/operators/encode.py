"""Label, category and target encoders, and class weights.

Fitted encoders hold their statistics as small Spark tables; applying them is a size-checked
lookup join, so a category column with very many values still works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstrata.runtime import lookup_join, small_rows

MAX_CLASSES = 10_000
INLINE_CLASSES = 32
MAX_CATEGORIES = 1_000_000


def _map_values(df: DataFrame, column: str, out: str, pairs: list[tuple], kind: str) -> DataFrame:
    """A CASE expression for a few values, a lookup join for many."""
    if len(pairs) <= INLINE_CLASSES:
        branch = F.lit(None).cast(kind)
        for a, b in reversed(pairs):
            branch = F.when(F.col(column) == F.lit(a), F.lit(b).cast(kind)).otherwise(branch)
        return df.withColumn(out, branch)
    source = df.schema[column].dataType.simpleString()
    table = df.sparkSession.createDataFrame(pairs, f"`{column}` {source}, `{out}` {kind}")
    return lookup_join(df, table, [column])


class LabelCodes:
    """Sorted classes and their codes 0..K-1. The number of classes is a model parameter."""

    def __init__(self, classes: list):
        self.classes = list(classes)

    @classmethod
    def fit(cls, df: DataFrame, label: str) -> "LabelCodes":
        distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
        return cls(sorted(r[0] for r in small_rows(distinct, MAX_CLASSES, "classes")))

    @property
    def k(self) -> int:
        return len(self.classes)

    def encode(self, df: DataFrame, label: str, out: str = "class_encoded") -> DataFrame:
        return _map_values(df, label, out, [(c, i) for i, c in enumerate(self.classes)], "int")

    def decode(self, df: DataFrame, code: str, out: str = "class") -> DataFrame:
        kind = "string" if all(isinstance(c, str) for c in self.classes) else "long"
        return _map_values(df, code, out, list(enumerate(self.classes)), kind)


class CategoryCodes:
    """Codes by descending frequency then name, fitted on train; all other values get code n.

    ``top`` keeps only the most frequent values (found by a distributed top-n).
    """

    def __init__(self, column: str, values: list[str]):
        self.column, self.values = column, list(values)

    @property
    def n(self) -> int:
        return len(self.values)

    @classmethod
    def fit(cls, df: DataFrame, column: str, top: int | None = None) -> "CategoryCodes":
        counts = (
            df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
        )
        if top is not None:
            counts = counts.orderBy(F.desc("__c"), column).limit(top)
        rows = small_rows(counts, MAX_CATEGORIES, f"categories of {column}")
        return cls(column, [r[column] for r in sorted(rows, key=lambda r: (-r["__c"], r[column]))])

    def encode(self, df: DataFrame, out: str) -> DataFrame:
        pairs = [(v, i) for i, v in enumerate(self.values)]
        return _map_values(df, self.column, "__code", pairs, "int").withColumn(
            out, F.coalesce("__code", F.lit(self.n))
        ).drop("__code")


def _class_counts(k: int, label: str) -> list[Column]:
    return [F.expr(f"count_if(`{label}` = {c})").alias(f"__c{c}") for c in range(k)]


class TargetEncoder:
    """Multiclass target encoding: one column per class for each category column.

    ``enc_c = (n_c + s * prior_c) / (n + s)`` with a fixed ``smooth`` s, or with ``smooth="auto"``
    s = within-category variance / global variance of the class indicator (Micci-Barreca 2001).
    Training rows are encoded from the other inner folds only, all folds from one aggregation. New
    rows use all of train; an unseen category gets the class prior.
    """

    def __init__(self, columns: list[str], k: int, smooth: float | str = 10.0, out: str = "{col}_te_{k}"):
        self.columns, self.k, self.smooth, self.out = list(columns), k, smooth, out

    def names(self, column: str | None = None) -> list[str]:
        cols = [column] if column else self.columns
        return [self.out.format(col=c, k=c2) for c in cols for c2 in range(self.k)]

    # statistics -------------------------------------------------------------------------------
    def _encoded(self, n: str, counts: list[str], total: int, totals: list[int]) -> list[str]:
        """SQL text of the K encodings; one string parses faster than a tree of column calls."""
        out = []
        for count, class_total in zip(counts, totals):
            prior = class_total / total if total else 1.0 / self.k
            if self.smooth == "auto":
                spread = prior * (1.0 - prior)
                p = f"(({count}) / ({n}))"
                s = f"({p} * (1D - {p}) / {spread!r}D)" if spread else "0D"
            else:
                s = f"{float(self.smooth)!r}D"
            shrunk = f"(({count}) + {s} * {prior!r}D) / (({n}) + {s})"
            out.append(f"case when ({n}) = 0 then {prior!r}D else {shrunk} end")
        return out

    def fit(self, train: DataFrame, label: str) -> "TargetEncoder":
        totals = train.agg(F.count(F.lit(1)).alias("n"), *_class_counts(self.k, label)).first()
        stats = {
            col: train.groupBy(col).agg(F.count(F.lit(1)).alias("__n"), *_class_counts(self.k, label))
            for col in self.columns
        }
        self._set_tables(stats, totals["n"], [totals[f"__c{c}"] for c in range(self.k)])
        return self

    def _set_tables(self, stats: dict[str, DataFrame], n: int, totals: list[int]) -> None:
        self.prior_ = [t / n for t in totals]
        self.tables_ = {}
        for col, table in stats.items():
            enc = self._encoded("__n", [f"__c{c}" for c in range(self.k)], n, totals)
            self.tables_[col] = table.select(
                col, *[F.expr(e).alias(x) for e, x in zip(enc, self.names(col))]
            )

    def transform(self, df: DataFrame) -> DataFrame:
        for col in self.columns:
            df = lookup_join(df, self.tables_[col], [col], null_safe=True)
            df = df.withColumns(
                {x: F.coalesce(x, F.lit(p)) for x, p in zip(self.names(col), self.prior_)}
            )
        return df

    def fit_transform(self, train: DataFrame, label: str, fold: str, k_folds: int) -> DataFrame:
        """Cross-fitted encodings of the training rows; also fits the tables for new rows.

        One aggregation per category column counts every (fold, class) side by side. A lookup row
        then carries, per class, the encodings for all folds; a row picks that of its own fold.
        """
        wide, totals = {}, None
        for col in self.columns:
            aggs = [F.expr(f"count_if(`{fold}` = {f})").alias(f"n{f}") for f in range(k_folds)]
            aggs += [
                F.expr(f"count_if(`{fold}` = {f} and `{label}` = {c})").alias(f"c{f}_{c}")
                for f in range(k_folds)
                for c in range(self.k)
            ]
            wide[col] = train.groupBy(col).agg(*aggs).persist()
            if totals is None:  # k_folds x (K + 1) numbers
                names = [x for x in wide[col].columns if x != col]
                totals = wide[col].agg(*[F.sum(x).alias(x) for x in names]).first().asDict()

        def others(column: str, f: int | None = None):
            """Names of a count over all folds but ``f``; ``column`` has a place for the fold."""
            return [column.format(g) for g in range(k_folds) if g != f]

        out = train
        for col, table in wide.items():
            per_fold = []
            for f in range(k_folds):
                names = [others("n{}", f)] + [others(f"c{{}}_{c}", f) for c in range(self.k)]
                sums = [sum(totals[x] for x in parts) for parts in names]
                text = [" + ".join(parts) for parts in names]
                per_fold.append(self._encoded(text[0], text[1:], sums[0], sums[1:]))
            arrays = [
                F.expr("array(" + ", ".join(e[c] for e in per_fold) + ")").alias(f"__te{c}")
                for c in range(self.k)
            ]
            out = lookup_join(out, table.select(col, *arrays), [col], null_safe=True)
            picked = {
                x: F.expr(f"__te{c}[`{fold}`]") for c, x in enumerate(self.names(col))
            }
            out = out.withColumns(picked).drop(*[f"__te{c}" for c in range(self.k)])
        every = {
            col: table.select(
                col,
                F.expr(" + ".join(others("n{}"))).alias("__n"),
                *[F.expr(" + ".join(others(f"c{{}}_{c}"))).alias(f"__c{c}") for c in range(self.k)],
            )
            for col, table in wide.items()
        }
        self._set_tables(
            every,
            sum(totals[x] for x in others("n{}")),
            [sum(totals[x] for x in others(f"c{{}}_{c}")) for c in range(self.k)],
        )
        return out


class MeanTargetEncoder:
    """Target encoding that averages the encoded label as a number.

    ``blend="ratio"``: weight n / (n + s). ``blend="sigmoid"``: weight
    1 / (1 + exp(-(n - min_count) / smoothing)) (Micci-Barreca 2001), prior for one-row categories.
    Unseen or null categories get the prior.
    """

    def __init__(self, columns, smoothing=10.0, blend="ratio", min_count=20.0, out="{col}_mean"):
        self.columns, self.smoothing, self.blend = list(columns), float(smoothing), blend
        self.min_count, self.out = float(min_count), out

    def blended(self, n: Column, mean: Column, prior: float) -> Column:
        """Encoding of a category of ``n`` rows with this mean."""
        if self.blend == "ratio":
            return (n * mean + F.lit(self.smoothing * prior)) / (n + F.lit(self.smoothing))
        w = F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - F.lit(self.min_count)) / F.lit(self.smoothing)))
        return F.when(n == 1, F.lit(prior)).otherwise(F.lit(prior) * (F.lit(1.0) - w) + mean * w)

    def fit(self, train: DataFrame, label: str) -> "MeanTargetEncoder":
        prior = train.agg(F.avg(label)).first()[0]
        self.prior_, self.tables_ = float(prior), {}
        for col in self.columns:
            n, mean = F.count(F.lit(1)), F.avg(label)
            stats = train.where(F.col(col).isNotNull()).groupBy(col).agg(n.alias("n"), mean.alias("m"))
            e = self.blended(F.col("n"), F.col("m"), self.prior_)
            self.tables_[col] = stats.select(col, e.alias(self.out.format(col=col)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for col in self.columns:
            name = self.out.format(col=col)
            df = lookup_join(df, self.tables_[col], [col])
            df = df.withColumn(name, F.coalesce(name, F.lit(self.prior_)))
        return df


# class weights ------------------------------------------------------------------------------------
def class_weight_table(df: DataFrame, label: str, mode: str = "balanced") -> dict:
    """Weight per class. balanced: n/(K n_k); max_ratio: max n / n_k; sqrt_ratio: its square root."""
    rows = small_rows(
        df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), MAX_CLASSES, "classes"
    )
    return weights_from_counts({r[label]: r["n"] for r in rows}, mode)


def weights_from_counts(counts: dict, mode: str | None) -> dict:
    n, k, top = sum(counts.values()), len(counts), max(counts.values())
    if mode in (None, "none"):
        return {c: 1.0 for c in counts}
    if mode in ("balanced", "balanced_subsample"):
        return {c: n / (k * v) for c, v in counts.items()}
    if mode == "max_ratio":
        return {c: top / v for c, v in counts.items()}
    if mode == "sqrt_ratio":
        return {c: (top / v) ** 0.5 for c, v in counts.items()}
    raise ValueError(f"unknown class weight mode {mode!r}")


def weight_column(weights: dict, label: str) -> Column:
    branch = None
    for c, w in weights.items():
        cond = F.col(label) == F.lit(c)
        branch = F.when(cond, F.lit(w)) if branch is None else branch.when(cond, F.lit(w))
    return branch.otherwise(F.lit(1.0))
