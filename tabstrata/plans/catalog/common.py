"""Helpers shared by the registered queries: rounding for comparison, SQL snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Columns whose every operation is exact or identical in both engines; rounding could only add ties.
EXACT = {
    "u", "g", "r", "i", "z", "redshift", "redshift_mult_r", "redshift_mult_i",
    "u_sub_g", "g_sub_r", "r_sub_i", "i_sub_z", "u_sub_r", "u_sub_z",
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since the order of summation differs between engines; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" and c not in EXACT else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def R(expr: str, alias: str | None = None, digits: int = 6) -> str:
    if alias in EXACT:
        return f"cast({expr} as double) as {alias}"
    out = f"(round(cast({expr} as double), {digits}) + 0e0)"
    return f"{out} as {alias}" if alias else out


def RS(*columns: str) -> str:
    return ", ".join(R(c, c) for c in columns)
