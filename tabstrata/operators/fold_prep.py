"""Preprocessing of all fold models at once: each model gets its own encoded and scaled columns in one table.

Model j (the last one: j = k_folds) must not see fold j. Its encodings are sums over all rows without those of
fold j and, for a training row, without those of the row's inner fold, so one count table over (category, outer
fold, inner fold) serves every model: what a model may use is the total, less a fold, less an inner fold, plus
the cell in both. Means and spreads of numbers come from one aggregate by fold, quartiles from counts by fold. Nothing is refitted by fold and nothing is joined by key; a
category's row of encodings is looked up once, broadcast only when its size has been checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.operators.encode import MeanTargetEncoder, TargetEncoder
from tabstrata.operators.quantiles import fold_quantiles
from tabstrata.runtime import held, lookup_join, small_rows


class Scaled(str):
    """Name of a column that is (source - middle) / spread: learners may read the source once for all models."""

    def __new__(cls, name: str, source: str, middle: float, spread: float):
        made = super().__new__(cls, name)
        made.source, made.middle, made.spread = source, middle, spread
        return made

    def __getnewargs__(self):
        return str(self), self.source, self.middle, self.spread


def own(column: str, model: int) -> str:
    """Name of a column as model ``model`` sees it."""
    return f"{column}__m{model}"


def mean_encoded(
    df: DataFrame, encoder: MeanTargetEncoder, label: str, fold: str, k_folds: int
) -> tuple[DataFrame, list[list[str]]]:
    """``df`` plus the mean target encodings of every model, and each model's column names."""
    models, names, out = range(k_folds + 1), [[] for _ in range(k_folds + 1)], df
    sums = df.groupBy(fold).agg(F.count(label).alias("n"), F.sum(label).alias("s"))
    by_fold = {r[fold]: (r["n"], r["s"]) for r in small_rows(sums, 10_000, "folds")}
    prior = []
    for j in models:
        rest = [v for f, v in by_fold.items() if f != j]
        n = sum(v[0] for v in rest)
        prior.append(float(sum(v[1] for v in rest) / n) if n else 0.0)
    for col in encoder.columns:
        aggs = [F.expr(f"count_if(`{fold}` = {j})").alias(f"n{j}") for j in range(k_folds)]
        aggs += [F.expr(f"coalesce(sum(case when `{fold}` = {j} then `{label}` end), 0)").alias(f"s{j}") for j in range(k_folds)]
        table = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("s"), *aggs)
        values = []
        for j in models:
            n = F.col("n") - F.col(f"n{j}") if j < k_folds else F.col("n")
            s = F.col("s") - F.col(f"s{j}") if j < k_folds else F.col("s")
            values.append(F.when(n > 0, encoder.blended(n, s / n, prior[j])).otherwise(F.lit(prior[j])))
        out = lookup_join(out, table.select(col, F.array(*values).alias("__enc")), [col])
        made = {own(encoder.out.format(col=col), j): F.coalesce(F.col("__enc")[j], F.lit(prior[j])) for j in models}
        out = out.withColumns(made).drop("__enc")
        for j in models:
            names[j].append(own(encoder.out.format(col=col), j))
    return out, names


def class_encoded(
    df: DataFrame, encoder: TargetEncoder, label: str, fold: str, k_folds: int, inner: str, inner_folds: int
) -> tuple[DataFrame, list[list[str]]]:
    """``df`` plus the target encodings of every model: cross-fitted over ``inner`` on a model's training rows,
    from all of them on the rows of the fold it leaves out."""
    k, models, out = encoder.k, range(k_folds + 1), df
    names = [[] for _ in models]
    kinds = ["n"] + [f"c{c}_" for c in range(k)]
    at = {"n": "true"} | {f"c{c}_": f"__y = {c}" for c in range(k)}
    cells = [(x, f, i) for x in kinds for f in range(k_folds) for i in range(inner_folds)]
    for col in encoder.columns:
        # counted by cell first, so that a row is compared with no cell but its own
        aggs = [
            F.expr(f"coalesce(sum(case when __f = {f} and __i = {i} and {at[x]} then __n end), 0)").alias(f"{x}{f}_{i}")
            for x, f, i in cells
        ]
        by_cell = df.groupBy(col, F.col(fold).alias("__f"), F.col(inner).alias("__i"), F.col(label).alias("__y"))
        table = held(by_cell.agg(F.count(F.lit(1)).alias("__n")).groupBy(col).agg(*aggs))
        margins = {}
        for x in kinds:
            for f in range(k_folds):
                margins[f"{x}f{f}"] = " + ".join(f"{x}{f}_{i}" for i in range(inner_folds))
            for i in range(inner_folds):
                margins[f"{x}i{i}"] = " + ".join(f"{x}{f}_{i}" for f in range(k_folds))
            margins[f"{x}t"] = " + ".join(f"{x}{f}_{i}" for f in range(k_folds) for i in range(inner_folds))
        table = table.select("*", *[F.expr(e).alias(x) for x, e in margins.items()]).persist()
        try:
            wide = [c for c in table.columns if c != col]
            totals = table.agg(*[F.sum(c).alias(c) for c in wide]).first().asDict()  # folds x inner folds x (K + 2) numbers

            def seen(x: str, j: int, i: int) -> tuple[str, int]:
                """What model j counts for a row of inner fold i (inner_folds: one it does not train on)."""
                plus, minus = [f"{x}t"], []
                if j < k_folds:
                    minus.append(f"{x}f{j}")
                if i < inner_folds:
                    minus.append(f"{x}i{i}")
                    plus += [f"{x}{j}_{i}"] if j < k_folds else []
                value = sum(totals[p] or 0 for p in plus) - sum(totals[m] or 0 for m in minus)
                return " + ".join(plus) + "".join(f" - {m}" for m in minus), value

            arrays = [[] for _ in range(k)]
            for j in models:
                for i in range(inner_folds + 1):
                    n, *counts = [seen(x, j, i) for x in kinds]
                    for c, text in enumerate(encoder._encoded(n[0], [t for t, _ in counts], n[1], [v for _, v in counts])):
                        arrays[c].append(text)
            looked = table.select(col, *[F.expr(f"array({', '.join(a)})").alias(f"__te{c}") for c, a in enumerate(arrays)])
            out = lookup_join(out, looked, [col], null_safe=True)
        finally:
            table.unpersist()
        made = {}
        for j in models:
            i = F.when(F.col(fold) == j, inner_folds).otherwise(F.col(inner))
            for c, name in enumerate(encoder.names(col)):
                made[own(name, j)] = F.get(f"__te{c}", (F.lit(j * (inner_folds + 1)) + i).cast("int"))
                names[j].append(own(name, j))
        out = out.withColumns(made).drop(*[f"__te{c}" for c in range(k)])
    return out, names


def scaled(
    df: DataFrame, standard: list[str], robust: list[str], fold: str, k_folds: int, rows: DataFrame | None = None
) -> tuple[DataFrame, list[list[str]]]:
    """``df`` plus the columns standardised and robust-scaled by each model's training rows.

    ``rows`` are the same rows without what ``df`` has looked up, if scales are to be taken from these.
    """
    plain = df if rows is None else rows
    models, at = range(k_folds + 1), {}
    if standard:
        aggs = [F.count(F.lit(1)).alias("n")]
        aggs += [x for c in standard for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
        sums = small_rows(plain.groupBy(fold).agg(*aggs), 10_000, "folds")
        for j in models:
            part = [r for r in sums if r[fold] != j]
            n = sum(r["n"] for r in part)
            for c in standard:
                mean = sum(r["n"] * r[f"m_{c}"] for r in part) / n
                spread = (sum(r["n"] * (r[f"v_{c}"] + (r[f"m_{c}"] - mean) ** 2) for r in part) / n) ** 0.5
                at[own(c, j)] = c, mean, spread or 1.0
    if robust:
        q = fold_quantiles(plain, robust, [0.25, 0.5, 0.75], fold, k_folds)
        for j in models:
            for c in robust:
                low, middle, high = q[j][c]
                at[own(c, j)] = c, middle, (high - low) or 1.0
    made = {a: (F.col(c) - F.lit(middle)) / F.lit(spread) for a, (c, middle, spread) in at.items()}
    names = [[Scaled(own(c, j), *at[own(c, j)]) for c in [*standard, *robust]] for j in models]
    return df.withColumns(made), names
