"""Deterministic folds: the same row gets the same fold under any partitioning.

A shuffled, balanced fold is ``(rank - 1) % k`` where rank follows md5(seed|key). Ranking a label
that holds a third of a huge table in one window would put all of it in one task, so the rank is
split: the first hex digits of the hash are a bucket of near-equal size, the rank inside a bucket
comes from a window over (label, bucket), and a small table of bucket counts gives the offset.
The result equals the single-window rank exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstrata.functions.hashing import seeded_md5, unit_hash


def hash_rank(
    df: DataFrame, key: str, seed, strata: list[str] | None = None, out: str = "rank", digits: int = 4
) -> DataFrame:
    """1-based rank of every row by (md5(seed|key), key) within its stratum.

    ``digits`` sets 16**digits buckets per stratum: with 4 a stratum of 10**12 rows has buckets of
    15 million rows, and the table of bucket counts has 65,536 rows. ``key`` must be unique.
    """
    groups = {
        f"__s{i}": F.coalesce(F.col(s).cast("string"), F.lit("\u0000")) for i, s in enumerate(strata or [])
    }
    tagged = df.withColumns({**groups, "__h": seeded_md5(seed, key)}).withColumn(
        "__b", F.substring("__h", 1, digits)
    )
    counts = tagged.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *groups, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    inside = Window.partitionBy(*groups, "__b").orderBy("__h", key)
    ranked = tagged.withColumn("__rn", F.row_number().over(inside))
    # the window has already placed the rows by the join key, so the join shuffles counts only
    joined = ranked.join(offsets, [*groups, "__b"])
    return joined.withColumn(out, F.col("__rn") + F.col("__off")).drop(
        *groups, "__h", "__b", "__rn", "__off"
    )


def stratified_folds(
    df: DataFrame, key: str = "id", label: str = "class_encoded", k: int = 5, seed=42, out: str = "fold"
) -> DataFrame:
    """Shuffled stratified k-fold: class shares differ by at most one row between folds."""
    ranked = hash_rank(df, key, seed, [label], "__rank")
    return ranked.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def complement_folds(
    df: DataFrame, key: str, label: str, fold: str, k_folds: int, k: int = 5, seed=42, out: str = "__cal{j}", digits: int = 4
) -> DataFrame:
    """``df`` plus, for each fold j, the :func:`stratified_folds` of the rows outside it; null inside.

    A rank among the rows outside fold j is a running count of these, so one ranking serves all of them.
    """
    names, stratum = [out.format(j=j) for j in range(k_folds)], F.coalesce(F.col(label).cast("string"), F.lit("\u0000"))
    tagged = df.withColumns({"__s": stratum, "__h": seeded_md5(seed, key)}).withColumn("__b", F.substring("__h", 1, digits))
    outside = [F.count_if(F.col(fold) != j) for j in range(k_folds)]
    counts = tagged.groupBy("__s", "__b").agg(*[c.alias(f"__n{j}") for j, c in enumerate(outside)])
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(f"__n{j}").over(before), F.lit(0)).alias(f"__off{j}") for j in range(k_folds)]
    so_far = Window.partitionBy("__s", "__b").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tagged.withColumns({f"__rn{j}": c.over(so_far) for j, c in enumerate(outside)})
    joined = ranked.join(counts.select("__s", "__b", *sums), ["__s", "__b"])
    made = {n: F.when(F.col(fold) != j, (F.col(f"__rn{j}") + F.col(f"__off{j}") - 1) % k).cast("int") for j, n in enumerate(names)}
    return joined.withColumns(made).select(*df.columns, *names)


def plain_folds(df: DataFrame, key: str = "id", k: int = 5, seed=42, out: str = "fold") -> DataFrame:
    """Shuffled k-fold; fold sizes differ by at most one row."""
    ranked = hash_rank(df, key, seed, None, "__rank")
    return ranked.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def hashed_folds(df: DataFrame, key: str = "id", k: int = 5, seed=42, out: str = "fold") -> DataFrame:
    """Shuffle-free k-fold by hash alone; sizes are near-equal only."""
    return df.withColumn(out, F.floor(unit_hash(seed, key) * k).cast("int"))


def fan_out(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every row once per outer fold j, with its role: 'valid' in its own fold, else 'train'.

    The long form of the k (train, valid) pairs, for aggregates over all pairs in one pass.
    """
    return df.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "role", F.when(F.col(fold) == F.col("outer_fold"), "valid").otherwise("train")
    )


def holdout_flag(key: str = "id", fraction: float = 0.1, seed=42) -> Column:
    """True for the rows kept aside for early stopping."""
    return unit_hash(f"{seed}|holdout", key) < fraction


def nested_folds(
    df: DataFrame,
    key: str = "id",
    label: str = "class_encoded",
    outer: str = "fold",
    k_outer: int = 5,
    k_inner: int = 5,
    seed=43,
    out: str = "inner_fold",
) -> DataFrame:
    """Inner stratified folds of every outer training set: one row per (outer fold j != own, row)."""
    train = fan_out(df, k_outer, outer).where(F.col("role") == "train").drop("role")
    ranked = hash_rank(train, key, seed, ["outer_fold", label], "__rank")
    return ranked.withColumn(out, ((F.col("__rank") - 1) % k_inner).cast("int")).drop("__rank")
