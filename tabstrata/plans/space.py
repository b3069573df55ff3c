"""Hyper-parameter spaces sampled by hash, as a DataFrame of trials (Bergstra & Bengio 2012)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstrata.functions.hashing import unit_hash


@dataclass(frozen=True)
class Param:
    """kind: float, log, int, choice. ``when`` = (other parameter, allowed values)."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 1.0
    step: int = 1
    choices: tuple = ()
    when: tuple | None = None

    def column(self, u: Column) -> Column:
        if self.kind == "float":
            return F.lit(float(self.low)) + u * F.lit(float(self.high - self.low))
        if self.kind == "log":
            lo, hi = math.log(self.low), math.log(self.high)
            return F.exp(F.lit(lo) + u * F.lit(hi - lo))
        if self.kind == "int":
            n = int((self.high - self.low) // self.step) + 1
            return (F.lit(int(self.low)) + F.lit(self.step) * F.floor(u * n)).cast("int")
        values = F.array(*[F.lit(None if c is None else str(c)) for c in self.choices])
        return F.element_at(values, (F.floor(u * len(self.choices)) + 1).cast("int"))

    def parse(self, value):
        """The sampled value as the Python object it stands for."""
        if self.kind != "choice":
            return value
        return {None if c is None else str(c): c for c in self.choices}[value]


def uniform(name, low, high, **kw):
    return Param(name, "float", low, high, **kw)


def log_uniform(name, low, high, **kw):
    return Param(name, "log", low, high, **kw)


def integer(name, low, high, step=1, **kw):
    return Param(name, "int", low, high, step, **kw)


def choice(name, *choices, **kw):
    return Param(name, "choice", choices=tuple(choices), **kw)


def sample(spark: SparkSession, space: list[Param], study: str, n: int, start: int = 0, seed=42) -> DataFrame:
    """(study, trial, one column per parameter); a value depends on seed, study, name and trial only."""
    trials = spark.range(start, start + n).select(F.col("id").cast("int").alias("trial"))
    for p in space:
        col = p.column(unit_hash(f"{seed}|{study}|{p.name}", "trial"))
        if p.when:
            other, allowed = p.when
            col = F.when(F.col(other).isin(*[str(a) for a in allowed]), col)
        trials = trials.withColumn(p.name, col)
    return trials.select(F.lit(study).alias("study"), "*")


def as_params(row, space: list[Param]) -> dict:
    """Parameters of one trial row; inactive conditional ones are left out."""
    out = {}
    for p in space:
        if p.when and row[p.name] is None:
            continue
        out[p.name] = p.parse(row[p.name])
    return out
