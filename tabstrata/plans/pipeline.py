"""A learner with its preprocessing, fitted per training part so that nothing leaks between folds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame

from tabstrata.learners.base import score as score_models
from tabstrata.operators import fold_prep
from tabstrata.operators.encode import MeanTargetEncoder
from tabstrata.operators.folds import hashed_folds
from tabstrata.operators.scale import ColumnComposer
from tabstrata.runtime import side_by_side

INNER_FOLDS = 5


class Fitted:
    """A preprocessing object (or None) and a model; ``score`` keeps the input columns."""

    def __init__(self, prep, model):
        self.prep, self.model = prep, model

    def score(self, df: DataFrame, prefix: str) -> DataFrame:
        k = self.model.k
        names = [f"{prefix}_{c}" for c in range(k)]
        if self.prep is None:
            return self.model.score(df, prefix).select(*df.columns, *names)
        # scaling replaces columns, so the originals are carried under other names
        kept = {f"__in_{c}": c for c in df.columns}
        wide = df.select("*", *[df[c].alias(a) for a, c in kept.items()])
        scored = self.model.score(self.prep.transform(wide), prefix)
        return scored.select(*[scored[a].alias(c) for a, c in kept.items()], *names)


class Pipeline:
    """``prep``: None, "compose" (target-encode, standardise, robust-scale) or "mean" (mean target
    encoding of the categories). A learner that can train all folds at once does: without ``prep``, or with
    columns of its own for each fold model if it takes such."""

    def __init__(self, learner, numeric, categories=(), prep=None, standard=("alpha", "delta"), key="id", parallel_fits=4):
        self.parallel_fits = parallel_fits
        self.learner, self.numeric, self.categories = learner, list(numeric), list(categories)
        self.prep, self.standard, self.key = prep, [c for c in standard if c in numeric], key
        self.k = learner.k

    def fit(self, df: DataFrame, label: str) -> Fitted:
        if self.prep is None:
            return Fitted(None, self._fit_learner(df, self.numeric, label))
        if self.prep == "mean":
            enc = MeanTargetEncoder(self.categories, blend="sigmoid").fit(df, label)
            ready = enc.transform(df)
            features = self.numeric + [enc.out.format(col=c) for c in self.categories]
            return Fitted(enc, self._fit_cached(ready, features, label))
        rest = [c for c in self.numeric if c not in self.standard]
        comp = ColumnComposer(self.categories, self.standard, rest, self.k)
        inner = hashed_folds(df, self.key, INNER_FOLDS, "inner", "__inner")
        ready = comp.fit_transform(inner, label, "__inner", INNER_FOLDS)
        return Fitted(comp, self._fit_cached(ready, comp.features, label))

    def _fit_cached(self, ready: DataFrame, features, label):
        """Preprocessed rows, of the columns a learner reads, are cached for the passes of the fit only."""
        ready = ready.select(*[c for c in dict.fromkeys([self.key, label, *features]) if c in ready.columns]).persist()
        try:
            return self._fit_learner(ready, features, label)
        finally:
            ready.unpersist()

    def _fit_learner(self, df, features, label):
        if hasattr(self.learner, "numeric"):  # the boosting core names its own columns
            return self.learner.fit(df, label)
        return self.learner.fit(df, features, label)

    @property
    def parallel_folds(self) -> bool:
        ready = self.prep is None or getattr(self.learner, "feature_lists", False)
        return ready and hasattr(self.learner, "fit_folds")

    def prepared(self, df: DataFrame, label: str, fold: str, k_folds: int) -> tuple[DataFrame, list[list[str]]]:
        """``df`` plus the preprocessed columns of every fold model, and each model's features."""
        if self.prep == "mean":
            enc = MeanTargetEncoder(self.categories, blend="sigmoid")
            ready, names = fold_prep.mean_encoded(df, enc, label, fold, k_folds)
            return ready, [self.numeric + n for n in names]
        rest = [c for c in self.numeric if c not in self.standard]
        encoder = ColumnComposer(self.categories, self.standard, rest, self.k).encoder
        inner = hashed_folds(df, self.key, INNER_FOLDS, "inner", "__inner")
        ready, names = fold_prep.class_encoded(inner, encoder, label, fold, k_folds, "__inner", INNER_FOLDS)
        ready, more = fold_prep.scaled(ready, self.standard, rest, fold, k_folds, inner)
        return ready, [a + b for a, b in zip(names, more)]

    def fold_models(self, df: DataFrame, label: str, fold: str, k_folds: int, features=None):
        """Models leaving out each fold from shared passes; some learners fit the model of all rows along with them."""
        only = getattr(self.learner, "folds_only", False)
        rest = {"whole": False} if only else {}
        if hasattr(self.learner, "numeric"):
            return self.learner.fit_folds(df, label, fold, k_folds, **rest)
        if features is not None and only:
            features = features[:k_folds]
        return self.learner.fit_folds(df, self.numeric if features is None else features, label, fold, k_folds, **rest)

    def out_of_fold(self, df: DataFrame, label: str, fold: str, k_folds: int, prefix: str) -> DataFrame:
        """Every row scored by the model that did not train on it."""
        if self.parallel_folds:
            names = [f"{prefix}_{c}" for c in range(self.k)]
            if self.prep is not None:
                ready, features = self.prepared(df, label, fold, k_folds)
                models = self.fold_models(ready, label, fold, k_folds, features)
                return score_models(ready, models, prefix, fold).select(*df.columns, *names)
            models = self.fold_models(df, label, fold, k_folds)
            return score_models(df, models, prefix, fold).select(*df.columns, *names)
        if hasattr(self.learner, "fit_out_of_fold"):
            return self._nested_out_of_fold(df, label, fold, k_folds, prefix)
        # independent fits: their jobs run side by side, as many as parallel_fits while rows are few
        with ThreadPoolExecutor(side_by_side(df, min(k_folds, self.parallel_fits))) as pool:
            parts = list(pool.map(lambda j: self.fold_scored(df, label, fold, j, prefix), range(k_folds)))
        return reduce(DataFrame.unionByName, parts)

    def _nested_out_of_fold(self, df: DataFrame, label: str, fold: str, k_folds: int, prefix: str) -> DataFrame:
        """For learners with folds of their own: these and the preprocessing come from shared passes for all folds."""
        ready, features = self.learner.inner_folds(df, label, fold, k_folds), self.numeric
        if self.prep is not None:
            ready, lists = self.prepared(ready, label, fold, k_folds)
            features = lists[:k_folds]
        models = self.learner.fit_out_of_fold(ready, features, label, fold, k_folds, self.parallel_fits)
        return score_models(ready, models, prefix, fold).select(*df.columns, *[f"{prefix}_{c}" for c in range(self.k)])

    def fold_scored(self, df: DataFrame, label: str, fold: str, j: int, prefix: str) -> DataFrame:
        fitted = self.fit(df.where(df[fold] != j), label)
        return fitted.score(df.where(df[fold] == j), prefix)
