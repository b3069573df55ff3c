"""Exact quantiles whose memory does not grow with the table.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Below ``exact_limit``
rows that is the quickest way. Above it the wanted order statistics are bracketed by repeated
histograms: each pass counts the rows of every open bracket in ``bins`` equal slices (map-side
aggregation, no row is shuffled) and keeps the slice holding the wanted rank, until the bracket
holds few enough values to rank them directly. Both ways return the same numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstrata.learners.base import blocks, partial_sums
from tabstrata.runtime import small_rows

EXACT_LIMIT = 2_000_000
MAX_GROUPS = 10_000


def _long(df: DataFrame, columns, by) -> DataFrame:
    """(by..., name, value) with nulls dropped; a streaming unpivot."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(*by, F.explode(pairs).alias("e"))
        .select(*by, "e.name", "e.value")
        .where(F.col("value").isNotNull())
    )


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    by: list[str] | None = None,
    exact_limit: int = EXACT_LIMIT,
    bins: int = 1024,
) -> dict[tuple, dict[str, list[float]]]:
    """Linear-interpolated quantiles per group and column: {group tuple: {column: [values]}}."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        aggs += [F.count(c).alias(f"__n_{c}"), F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}")]
    groups = small_rows(df.groupBy(*by).agg(*aggs), MAX_GROUPS, "quantile groups")
    if max((g["__n"] for g in groups), default=0) <= exact_limit:
        probs_lit = F.array(*[F.lit(float(p)) for p in probs])
        rows = small_rows(
            df.groupBy(*by).agg(*[F.percentile(c, probs_lit).alias(c) for c in columns]),
            MAX_GROUPS,
            "quantile groups",
        )
        return {tuple(r[b] for b in by): {c: r[c] for c in columns} for r in rows}

    # rank targets: both neighbours of each interpolated position
    found: dict[tuple, float] = {}
    open_: dict[tuple, dict] = {}
    for gi, g in enumerate(groups):
        for c in columns:
            n = g[f"__n_{c}"]
            for p in probs:
                if n == 0:
                    continue
                pos = p * (n - 1)
                for rank in {math.floor(pos), math.ceil(pos)}:
                    open_[(gi, c, rank)] = dict(
                        lo=float(g[f"__lo_{c}"]), hi=float(g[f"__hi_{c}"]), below=0, n=n
                    )
    values = _long(df, columns, by)
    group_id = {tuple(g[b] for b in by): i for i, g in enumerate(groups)}
    for _ in range(64):
        for key in [k for k, t in open_.items() if t["lo"] == t["hi"]]:
            found[key] = open_.pop(key)["lo"]
        if not any(t["n"] > exact_limit for t in open_.values()):
            break
        open_ = _narrow(df.sparkSession, values, by, group_id, open_, bins)
    if open_:
        found.update(_resolve(df.sparkSession, values, by, group_id, open_))

    out: dict[tuple, dict[str, list[float]]] = {}
    for gi, g in enumerate(groups):
        per = {}
        for c in columns:
            n = g[f"__n_{c}"]
            if n == 0:
                per[c] = None
                continue
            res = []
            for p in probs:
                pos = p * (n - 1)
                lo, hi = math.floor(pos), math.ceil(pos)
                a, b = found[(gi, c, lo)], found[(gi, c, hi)]
                res.append(a if lo == hi else (hi - pos) * a + (pos - lo) * b)
            per[c] = res
        out[tuple(g[b] for b in by)] = per
    return out


def _targets(spark, by, group_id, open_, schema) -> DataFrame:
    names = list(group_id)
    rows, seen = [], set()
    for (gi, c, _), t in open_.items():
        key = (gi, c, t["lo"], t["hi"])
        if key not in seen:
            seen.add(key)
            rows.append((*names[gi], c, gi, t["lo"], t["hi"]))
    fields = [schema[b] for b in by]
    from pyspark.sql import types as T

    st = T.StructType(
        fields
        + [
            T.StructField("name", T.StringType()),
            T.StructField("gi", T.IntegerType()),
            T.StructField("lo", T.DoubleType()),
            T.StructField("hi", T.DoubleType()),
        ]
    )
    return spark.createDataFrame(rows, st)


def _bracketed(spark, values, by, group_id, open_) -> DataFrame:
    """Values inside any open bracket, tagged with it. The brackets are groups x columns x ranks."""
    t = _targets(spark, by, group_id, open_, values.schema).alias("t")
    cond = (F.col("v.name") == F.col("t.name")) & F.col("v.value").between(
        F.col("t.lo"), F.col("t.hi")
    )
    for b in by:
        cond = cond & F.col(f"v.{b}").eqNullSafe(F.col(f"t.{b}"))
    return (
        values.alias("v")
        .join(F.broadcast(t), cond)
        .select("t.gi", F.col("t.name").alias("name"), "t.lo", "t.hi", "v.value")
    )


def _narrow(spark, values, by, group_id, open_, bins) -> dict:
    inside = _bracketed(spark, values, by, group_id, open_)
    slot = F.least(
        F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)
    ).cast("int")
    counts = (
        inside.where(F.col("lo") < F.col("hi"))
        .groupBy("gi", "name", "lo", "hi", slot.alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    )
    table: dict[tuple, list] = {}
    for r in small_rows(counts, bins * len(open_) + 1, "quantile histogram"):
        table.setdefault((r["gi"], r["name"], r["lo"], r["hi"]), []).append(r)
    nxt = {}
    for (gi, c, rank), t in open_.items():
        below = t["below"]
        for r in sorted(table[(gi, c, t["lo"], t["hi"])], key=lambda r: r["slot"]):
            if rank < below + r["n"]:
                # the bracket shrinks to the slice's own extremes, so repeated values end at once
                nxt[(gi, c, rank)] = dict(lo=r["vmin"], hi=r["vmax"], below=below, n=r["n"])
                break
            below += r["n"]
    return nxt


def _resolve(spark, values, by, group_id, open_) -> dict:
    """Rank the few remaining values of each bracket after merging equal ones."""
    merged = (
        _bracketed(spark, values, by, group_id, open_)
        .groupBy("gi", "name", "lo", "hi", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("gi", "name", "lo", "hi").orderBy("value")
    ranked = merged.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = {}
    wanted = [
        (F.col("gi") == gi)
        & (F.col("name") == c)
        & (F.col("lo") == t["lo"])
        & (F.col("hi") == t["hi"])
        & (F.col("upto") > rank - t["below"])
        & (F.col("upto") - F.col("n") <= rank - t["below"])
        for (gi, c, rank), t in open_.items()
    ]
    cond = wanted[0]
    for x in wanted[1:]:
        cond = cond | x
    hits = ranked.where(cond).collect()
    for (gi, c, rank), t in open_.items():
        for r in hits:
            if (
                (r["gi"], r["name"], r["lo"], r["hi"]) == (gi, c, t["lo"], t["hi"])
                and r["upto"] - r["n"] <= rank - t["below"] < r["upto"]
            ):
                found[(gi, c, rank)] = r["value"]
    return found


#: Counts that a task of :func:`fold_quantiles` holds (64 MB).
PASS_CELLS = 1 << 23


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of some doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(bits: int) -> float:
    bits = bits ^ (1 << 63) if bits >> 63 else ~bits & (2**64 - 1)
    return float(np.uint64(bits).view(np.float64))


def fold_quantiles(df: DataFrame, columns: list[str], probs: list[float], fold: str, k_folds: int) -> list[dict[str, list[float]]]:
    """:func:`quantiles` of the rows outside each fold 0 .. k_folds - 1, then of all rows.

    The wanted order statistics are read off digit by digit: a double is an integer of 64 bits, and each of four to
    six passes counts, by fold, the rows that share the bits found so far by their next 16 (fewer where many
    prefixes are asked for). What a model leaves out is a difference of counts, so that all models share the
    passes, in which no row is shuffled.
    """
    models, d = k_folds + 1, len(columns)
    rows = blocks(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(fold).cast("int").alias("f"))).persist()

    def count(done: int, width: int, prefixes: list[list[int]]) -> list[np.ndarray]:
        """Per column (prefix, k_folds + 1, digit) rows, the last of no fold, by ``width`` bits after ``done``."""
        first, digits = np.cumsum([0] + [len(p) for p in prefixes]), 1 << width
        rest, down = np.uint64(64 - done), np.uint64(64 - done - width)

        def add(batch, acc):
            view = acc.reshape(first[-1], models, digits)
            f = batch.column("f").to_numpy(zero_copy_only=False)
            f = np.where((f >= 0) & (f < k_folds), f, k_folds).astype(np.int64)
            for i, known in enumerate(prefixes):
                column = batch.column(f"x{i}")
                bits = ordered_bits(column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False))
                keep = column.is_valid().to_numpy(zero_copy_only=False)
                above = bits >> rest if done else None
                digit = ((bits >> down) & np.uint64(digits - 1)).astype(np.int64) + f * digits
                for p, prefix in enumerate(known):
                    found = digit[keep & (above == np.uint64(prefix))] if done else digit[keep]
                    at, n = np.unique(found, return_counts=True)
                    view[first[i] + p].reshape(-1)[at] += n

        sums = partial_sums(rows, ["f"], add, int(first[-1]) * models * digits, True).reshape(first[-1], models, digits)
        return [sums[a:b] for a, b in zip(first[:-1], first[1:])]

    try:
        known = [[0]] * d
        wanted: dict[tuple, list] = {}  # (model, column, rank): [digits found so far, rows below them]
        sizes = np.zeros((models, d), dtype=np.int64)
        done = 0
        while done < 64:
            width = min(16, 64 - done)
            while width > 4 and (sum(map(len, known)) * models << width) > PASS_CELLS:
                width -= 4
            tables = count(done, width, known)
            if not done:
                for i, t in enumerate(tables):
                    by_fold = t[0].sum(axis=1)
                    for j in range(models):
                        sizes[j, i] = n = int(by_fold.sum() - (by_fold[j] if j < k_folds else 0))
                        ranks = {r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))} if n else ()
                        wanted |= {(j, i, r): [0, 0] for r in ranks}
            upto = {}
            for (j, i, rank), state in wanted.items():
                at = known[i].index(state[0])
                if (j, i, at) not in upto:
                    own = tables[i][at].sum(axis=0) - (tables[i][at][j] if j < k_folds else 0)
                    upto[j, i, at] = np.concatenate([[0], np.cumsum(own)])
                found = int(np.searchsorted(upto[j, i, at], rank - state[1], side="right")) - 1
                state[:] = (state[0] << width) + found, state[1] + int(upto[j, i, at][found])
            known = [sorted({s[0] for (_, c, _), s in wanted.items() if c == i}) for i in range(d)]
            done += width
    finally:
        rows.unpersist()

    out = []
    for j in range(models):
        per = {}
        for i, c in enumerate(columns):
            if not (n := int(sizes[j, i])):
                per[c] = None
                continue
            per[c] = []
            for p in probs:
                pos = p * (n - 1)
                lo, hi = math.floor(pos), math.ceil(pos)
                a, b = _double(wanted[j, i, lo][0]), _double(wanted[j, i, hi][0])
                per[c].append(a if lo == hi else (hi - pos) * a + (pos - lo) * b)
        out.append(per)
    return out
