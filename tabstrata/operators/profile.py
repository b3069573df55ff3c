"""Column profiling: the numbers behind every plot, as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstrata.operators.quantiles import EXACT_LIMIT, MAX_GROUPS, quantiles
from tabstrata.runtime import small_rows


def null_fractions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, null_fraction): one aggregate for all columns, unpivoted from its single row."""
    columns = columns or df.columns
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("null_fraction")) for c in columns]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def numeric_summary(
    df: DataFrame, columns: list[str], exact_limit: int = EXACT_LIMIT
) -> DataFrame:
    """(column, max, min, median, mean, std): sample deviation, exact median."""
    medians = quantiles(df, columns, [0.5], exact_limit=exact_limit)[()]
    aggs = []
    for c in columns:
        aggs += [
            F.max(c).alias(f"{c}__max"),
            F.min(c).alias(f"{c}__min"),
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_samp(c).alias(f"{c}__std"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}__max").cast("double").alias("max"),
            F.col(f"{c}__min").cast("double").alias("min"),
            F.lit(medians[c][0] if medians[c] else None).cast("double").alias("median"),
            F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__std").alias("std"),
        )
        for c in columns
    ]
    return df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def auto_bins(n: int, lo: float, hi: float, iqr: float) -> int:
    """Number of bins from the narrower of the Sturges (1926) and Freedman-Diaconis (1981) widths."""
    if n == 0 or hi == lo:
        return 1
    sturges = (hi - lo) / (math.log2(n) + 1.0)
    fd = 2.0 * iqr / n ** (1.0 / 3.0)
    width = min(sturges, fd) if fd > 0 else sturges
    return max(1, math.ceil((hi - lo) / width))


def histogram(
    df: DataFrame, column: str, bins: int | str = "auto", exact_limit: int = EXACT_LIMIT
) -> DataFrame:
    """(bin, lo, hi, n) for every bin, empty ones included; the maximum joins the last bin."""
    spark = df.sparkSession
    row = df.agg(
        F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")
    ).first()
    if not row["n"]:  # nothing but nulls: no bins
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    n, lo, hi = row["n"], float(row["lo"]), float(row["hi"])
    if bins == "auto":
        q1, q3 = quantiles(df, [column], [0.25, 0.75], exact_limit=exact_limit)[()][column]
        bins = auto_bins(n, lo, hi, q3 - q1)
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(slot.alias("__slot"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # both sides have at most `bins` rows
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, frame["bin"] == counts["__slot"], "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


# exp(-t*t/2) is exactly zero in double precision beyond this many bandwidths
KERNEL_REACH = 38.7


def kernel_density(
    df: DataFrame, column: str, grid: int = 200, cut: float = 0.0, by: str | None = None
) -> DataFrame:
    """Gaussian kernel density on an even grid with Scott's bandwidth sd * n**(-1/5), exact.

    Each row meets only the grid points inside the kernel's reach, so the work per row shrinks with
    the bandwidth as the table grows; sums are combined map-side, and at most groups x grid rows
    are shuffled. With ``by`` each class has its own bandwidth, grid and normalisation.
    """
    spark = df.sparkSession
    keys = [by] if by else []
    df = df.select(*keys, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    stats = small_rows(
        df.groupBy(*keys).agg(
            F.count("x").alias("n"),
            F.stddev_samp("x").alias("sd"),
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
        ),
        MAX_GROUPS,
        "density groups",
    )
    params = []
    for r in stats:
        if r["n"] < 2 or not r["sd"]:
            continue  # no density is defined for a single value
        h = r["sd"] * r["n"] ** -0.2
        lo, hi = r["lo"] - cut * h, r["hi"] + cut * h
        params.append((*[r[k] for k in keys], r["n"], h, lo, (hi - lo) / (grid - 1)))
    if not params:
        raise ValueError(f"{column!r} has no group with two different values")
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("h", "g0", "step")]
    )
    p = spark.createDataFrame(params, schema)
    if by:
        rows = df.join(F.broadcast(p), by)  # one parameter row per class, at most MAX_GROUPS
    else:
        rows = df.select("x", *[F.lit(v).alias(c) for c, v in zip(("n", "h", "g0", "step"), params[0])])
    reach = F.lit(KERNEL_REACH) * F.col("h")
    first = F.greatest(F.ceil((F.col("x") - reach - F.col("g0")) / F.col("step")), F.lit(0))
    last = F.least(F.floor((F.col("x") + reach - F.col("g0")) / F.col("step")), F.lit(grid - 1))
    # a grid point beyond the reach of every row has density zero, so all points are listed below
    spread = rows.withColumns({"__f": first.cast("int"), "__l": last.cast("int")}).where("__f <= __l")
    spread = spread.withColumn("point", F.explode(F.sequence("__f", "__l")))
    t = (F.col("g0") + F.col("point") * F.col("step") - F.col("x")) / F.col("h")
    sums = spread.groupBy(*keys, "point").agg(F.sum(F.exp(-0.5 * t * t)).alias("__s"))
    frame = p.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    norm = F.lit(math.sqrt(2.0 * math.pi))
    return frame.join(sums, [*keys, "point"], "left").select(
        *keys,
        "point",
        (F.col("g0") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce("__s", F.lit(0.0)) / (F.col("n") * F.col("h") * norm)).alias("density"),
    )


def box_stats(
    df: DataFrame, column: str, by: str | None = None, exact_limit: int = EXACT_LIMIT
) -> DataFrame:
    """Quartiles, whiskers at the outermost rows within 1.5 IQR, and the outlier count."""
    spark = df.sparkSession
    keys = [by] if by else []
    q = quantiles(df, [column], [0.25, 0.5, 0.75], keys, exact_limit)
    rows = []
    for group, per in q.items():
        if per[column] is None:
            continue
        q1, q2, q3 = per[column]
        iqr = q3 - q1
        rows.append((*group, q1, q2, q3, q1 - 1.5 * iqr, q3 + 1.5 * iqr))
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField(c, T.DoubleType()) for c in ("q1", "median", "q3", "__low", "__high")]
    )
    fences = spark.createDataFrame(rows, schema)
    x = F.col(column).cast("double")
    data = df.select(*keys, x.alias("x")).where(F.col("x").isNotNull())
    if by:
        data = data.join(F.broadcast(fences), by)  # one row per class, at most MAX_GROUPS
    elif rows:
        data = data.select("x", *[F.lit(v).alias(f.name) for f, v in zip(schema.fields, rows[0])])
    else:  # nothing but nulls: no row
        data = data.join(fences, F.lit(False))
    inside = F.col("x").between(F.col("__low"), F.col("__high"))
    stats = ["q1", "median", "q3"]
    return data.groupBy(*keys, *stats).agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of non-null values, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def value_proportions(df: DataFrame, column: str) -> DataFrame:
    """(value, proportion) over non-null values; the total is a scalar subquery, not a window."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.select(F.sum("n")).scalar()
    return counts.select("value", (F.col("n") / total).alias("proportion")).orderBy(
        F.desc("proportion"), "value"
    )


def _success(target: str, success) -> Column:
    return (F.col(target).cast("string") == F.lit(str(success))).cast("int")


def target_rate(df: DataFrame, category: str, target: str, success) -> DataFrame:
    """(category, rate, global_rate) in percent, highest rate first. Null targets count as misses."""
    flag = F.coalesce(_success(target, success), F.lit(0))
    overall = df.select((F.avg(flag) * 100).alias("g")).scalar()
    return (
        df.where(F.col(category).isNotNull())
        .groupBy(category)
        .agg((F.avg(flag) * 100).alias("rate"))
        .select(category, "rate", overall.alias("global_rate"))
        .orderBy(F.desc("rate"), category)
    )


def _classes(df: DataFrame, target: str) -> list:
    distinct = df.select(target).where(F.col(target).isNotNull()).distinct()
    return sorted(r[0] for r in small_rows(distinct, MAX_GROUPS, "classes"))


def crosstab(df: DataFrame, category: str, target: str, classes: list | None = None) -> DataFrame:
    """Counts per (category, class), one column per class; nulls on either side are left out."""
    classes = classes or _classes(df, target)
    both = df.where(F.col(category).isNotNull() & F.col(target).isNotNull())
    return both.groupBy(category).agg(
        *[F.count(F.when(F.col(target) == c, 1)).alias(str(c)) for c in classes]
    )


def crosstab_percent(
    df: DataFrame, category: str, target: str, success=None, classes: list | None = None
) -> DataFrame:
    """Row percentages of :func:`crosstab`, sorted by the success class when it occurs."""
    classes = classes or _classes(df, target)
    names = [str(c) for c in classes]
    counts = crosstab(df, category, target, classes)
    row_sum = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    out = counts.select(category, *[(F.col(c) / row_sum * 100).alias(c) for c in names])
    if success is not None and str(success) in names:
        return out.orderBy(F.desc(str(success)), category)
    return out.orderBy(category)
