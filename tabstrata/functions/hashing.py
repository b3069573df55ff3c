"""Deterministic pseudo-randomness from md5, independent of partitioning and of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed, *columns) -> Column:
    """Hex md5 of ``seed|column|...``; the order every shuffled split follows."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def unit_hash(seed, *columns) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of :func:`seeded_md5`."""
    head = F.substring(seeded_md5(seed, *columns), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
