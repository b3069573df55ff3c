"""Column and row selection: the selector, fold subsets, previews and schema reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ColumnSelector:
    """Chooses columns by name, by position, by synthetic name ``x0..`` or by mask.

    ``resolve(columns)`` returns the chosen names in the order given (a mask keeps table order).
    Exactly one of ``features`` and ``mask`` must be set. With ``check_missing`` unknown names are
    reported as a sorted list. ``strict_mask`` insists on real booleans; otherwise entries are
    coerced.
    """

    def __init__(
        self,
        features: Iterable[str | int] | None = None,
        mask: Iterable | None = None,
        check_missing: bool = True,
        strict_mask: bool = True,
        synthetic_names: bool = False,
    ):
        if (features is None) == (mask is None):
            raise ValueError("give exactly one of features and mask")
        # numpy scalars count as the Python values they stand for
        plain = lambda v: v.item() if hasattr(v, "item") else v
        self.features = None if features is None else [plain(f) for f in features]
        self.mask = None if mask is None else [plain(m) for m in mask]
        if self.features and any(isinstance(f, bool) for f in self.features):
            raise TypeError("features are names or positions; give booleans as mask")
        self.check_missing = check_missing
        self.strict_mask = strict_mask
        self.synthetic_names = synthetic_names

    def resolve(self, columns: Sequence[str]) -> list[str]:
        columns = list(columns)
        if self.mask is not None:
            if self.strict_mask and not all(isinstance(m, bool) for m in self.mask):
                raise TypeError("mask must be boolean")
            if len(self.mask) != len(columns):
                raise ValueError(f"mask has {len(self.mask)} entries for {len(columns)} columns")
            return [c for c, keep in zip(columns, self.mask) if bool(keep)]
        if self.features and all(isinstance(f, int) for f in self.features):
            return [columns[i] for i in self.features]
        if self.synthetic_names:
            by_position = {f"x{i}": c for i, c in enumerate(columns)}
            unknown = sorted(set(self.features) - set(by_position))
            if unknown:
                raise ValueError(f"not a synthetic column name: {unknown}")
            return [by_position[f] for f in self.features]
        missing = sorted(set(self.features) - set(columns))
        if missing and self.check_missing:
            raise ValueError(f"features do not exist: {missing}")
        return [f for f in self.features if f in set(columns)]

    def select(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
        """The key columns followed by the selected ones; Catalyst prunes the rest at the scan."""
        return df.select(*key, *self.resolve([c for c in df.columns if c not in key]))

    def restore(self, selected: DataFrame, schema, key: Sequence[str] = ()) -> DataFrame:
        """Original columns in original order; those not selected come back as typed nulls."""
        have = set(selected.columns)
        out = []
        for field in schema.fields:
            if field.name in have:
                out.append(F.col(field.name))
            elif field.name not in key:
                out.append(F.lit(None).cast(field.dataType).alias(field.name))
        return selected.select(*out)

    def support(self, columns: Sequence[str]) -> list[bool]:
        chosen = set(self.resolve(columns))
        return [c in chosen for c in columns]

    def support_report(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
        """(pos, name, selected, out_pos, n_values): mask, positions (-1: left out) and fill count.

        Counting the values costs one aggregate over the table; the unpivot works on its single row.
        """
        columns = [c for c in df.columns if c not in key]
        chosen = self.resolve(columns)
        counted = df.agg(*[F.count(c).alias(c) for c in columns])
        entries = [
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(c).alias("name"),
                F.lit(c in chosen).alias("selected"),
                F.lit(chosen.index(c) if c in chosen else -1).alias("out_pos"),
                F.col(c).alias("n_values"),
            )
            for i, c in enumerate(columns)
        ]
        return counted.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def label_frame(df: DataFrame, key: str = "id", label: str = "class_encoded") -> DataFrame:
    return df.select(key, label)


def as_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Category columns are strings; their codes come from a fitted index (see encode)."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First n rows by key: a top-n per partition, then a merge; no full sort."""
    return df.orderBy(F.col(key).asc()).limit(n)


def tail(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.col(key).desc()).limit(n).orderBy(F.col(key).asc())


def shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, plus the row and column counts of the table."""
    entries = [
        F.struct(F.lit(i).alias("pos"), F.lit(name).alias("name"), F.lit(kind).alias("type"))
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("e", F.explode(F.array(*entries)))
        .select("e.pos", "e.name", "e.type", "n_rows", F.lit(len(df.columns)).alias("n_cols"))
    )


def fold_train(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) != k)


def fold_valid(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) == k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in ascending order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
