"""Isotonic calibration around linear learners, averaged over calibration folds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.learners.base import Model, ModelRows, as_matrix, feature_sets, part_of, rows_of, scaled_rows
from tabstrata.operators.folds import complement_folds, stratified_folds
from tabstrata.operators.isotonic import IsotonicMaps, ensemble_probabilities
from tabstrata.runtime import fewer_tasks, side_by_side


#: Columns of :meth:`Calibrated.inner_folds`.
CALIBRATION = "__cal{j}"


class CalibratedModel(Model):
    def __init__(self, members, maps: IsotonicMaps):
        self.members, self.maps = list(members), maps
        self.features, self.k = members[0].features, members[0].k

    def predict_array(self, x):
        margins = np.stack([m.margin_array(x) for m in self.members], axis=1)
        return ensemble_probabilities(self.maps, margins)


class Calibrated:
    """Fits the base learner on each calibration fold's complement (all at once), its held-out
    margins to isotonic curves per (fold, class), and averages the calibrated members."""

    def __init__(self, base, calib_folds: int = 5, key: str = "id", seed=42):
        self.base, self.calib_folds, self.key, self.seed = base, calib_folds, key, seed
        self.k = base.k

    def fit(self, df: DataFrame, features, label) -> CalibratedModel:
        narrow = df.select(self.key, label, *features)
        data = stratified_folds(narrow, self.key, label, self.calib_folds, self.seed, "__cal")
        data = fewer_tasks(data, narrow.count()).persist()
        try:
            return self._fit(data, features, label)
        finally:
            data.unpersist()

    def inner_folds(self, df: DataFrame, label: str, fold: str, k_folds: int) -> DataFrame:
        """``df`` plus the calibration folds of every fold's training rows, from one ranking, cached."""
        data = complement_folds(df, self.key, label, fold, k_folds, self.calib_folds, self.seed, CALIBRATION)
        return fewer_tasks(data, df.count()).persist()

    def fit_out_of_fold(self, df: DataFrame, features, label, fold: str, k_folds: int, at_once: int = 4) -> list[CalibratedModel]:
        """The model of each fold's complement, on a table with :meth:`inner_folds`; fits run side by side."""
        sets = feature_sets(features, k_folds)
        at_once = side_by_side(df, min(k_folds, at_once))
        shared = self._shares_rows(sets[0])
        if shared:  # one cached table for the models of all folds
            rows = ModelRows(df, sets, label, self.k, [F.col(CALIBRATION.format(j=j)) for j in range(k_folds)])

        def one(j: int) -> CalibratedModel:
            if shared:
                return self._fit_rows(rows, j, j)
            data = df.where(F.col(fold) != j).select(label, F.col(CALIBRATION.format(j=j)).alias("__cal"), *sets[j])
            return self._fit(data, sets[j], label)

        try:
            with ThreadPoolExecutor(at_once) as pool:
                return list(pool.map(one, range(k_folds)))
        finally:
            if shared:
                rows.close()

    def _shares_rows(self, features) -> bool:
        return hasattr(self.base, "fit_rows") and self.base.fits_rows(features)

    def _fit_rows(self, rows: ModelRows, at: int, part: int) -> CalibratedModel:
        """The model of the features ``at``, whose calibration folds are a part of the rows."""
        members, k, scale = self.base.fit_rows(rows, at, part, self.calib_folds, whole=False), self.k, rows.scales[at]

        def task(batches):
            for batch in batches:
                for block in rows_of(batch):
                    y, which, kept = part_of(block, part, rows=True)
                    x, out = scaled_rows(block, scale, kept)[:-1].T, np.empty((len(y), k))
                    for j in np.unique(which):
                        out[which == j] = members[int(j)].margin_array(x[which == j])
                    cls = np.tile(np.arange(k, dtype=np.int32), len(y))
                    hit = (np.repeat(y, k) == cls).astype(np.int32)
                    columns = [np.repeat(which, k).astype(np.int32), cls, out.ravel(), hit]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["__cal", "cls", "margin", "hit"])

        long = rows.frame.mapInArrow(task, "__cal int, cls int, margin double, hit int")
        return CalibratedModel(members, IsotonicMaps.fit(long, ["__cal", "cls"], "margin", "hit"))

    def _fit(self, data: DataFrame, features, label) -> CalibratedModel:
        k = self.k
        if self._shares_rows(features):
            rows = ModelRows(data, [list(features)], label, k, [F.col("__cal")])
            try:
                return self._fit_rows(rows, 0, 0)
            finally:
                rows.close()
        members = self.base.fit_folds(data, features, label, "__cal", self.calib_folds)[:-1]

        @F.pandas_udf("array<double>")
        def margins(part: pd.Series, *xs: pd.Series) -> pd.Series:
            x, which = as_matrix(xs), part.to_numpy()
            out = np.zeros((len(which), k))
            for j in np.unique(which):
                out[which == j] = members[int(j)].margin_array(x[which == j])
            return pd.Series(list(out))

        scored = data.select("__cal", label, margins("__cal", *features).alias("m"))
        long = scored.select(
            "__cal", F.posexplode("m").alias("cls", "margin"), F.col(label).alias("y")
        ).withColumn("hit", (F.col("y") == F.col("cls")).cast("int"))
        return CalibratedModel(members, IsotonicMaps.fit(long, ["__cal", "cls"], "margin", "hit"))
