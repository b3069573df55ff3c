"""Shared pieces: words of Arrow batches as numpy arrays, hashing, packed exchanges, components."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstrata.runtime import Steps, bounded_batches  # noqa: F401

#: Bytes of text that a task turns into numpy arrays at a time; a longer text is a slice of its own.
SLICE = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers, so that any slice of them can serve as a hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            while len(have) < n:
                have = np.concatenate([have, have * (have[-1] * base)])
        _powers[int(base)] = have
    return have[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = SLICE):
    """Row ranges [a, b) of about ``size`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = b


class Words:
    """The words of some texts: byte ranges, first word of each text, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE):
        low, base = int(offsets[0]), offsets - offsets[0]
        self.bytes = LOWER[data[low : int(offsets[-1])]]
        word = ~gap[self.bytes]
        n = len(word)
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = base[1:-1][base[1:-1] < n]
        first[edges] = word[edges]
        edges = base[1:-1][base[1:-1] > 0] - 1
        last[edges] = word[edges]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text i are at[i] : at[i + 1]
        self.at = np.searchsorted(self.start, base)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, by a polynomial over its bytes."""
        n = len(self.bytes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * powers(_P_INV, n)[self.start] if n else sums[:0]
        return mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside texts, and the first run of each text.

    A text of fewer words, but not none, has one run: all its words.
    """
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(words), np.uint64)
    for k in range(n):
        total[: len(words) - k] += words[k:] * factors[k]
    count = np.diff(at)
    runs = np.maximum(count - n + 1, (count > 0).astype(count.dtype))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    index = np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], runs)
    out = total[index]
    for i in np.flatnonzero((count > 0) & (count < n)):
        part = words[at[i] : at[i + 1]]
        out[bounds[i]] = (part * factors[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out), bounds


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_mod_of(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def one(df: DataFrame) -> dict:
    """The single row of an aggregate."""
    return df.first().asDict()


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpacked(column, dtype) -> np.ndarray:
    """Concatenation of the arrays packed in a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def power_of_two(x: float, least: int = 1) -> int:
    n = least
    while n < x:
        n *= 2
    return n


def runs_of(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length as last element."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b): the smallest node reachable.

    Alternating stars: each round hangs neighbours onto the smallest one, by joins on aggregated
    minima, so no adjacency list is ever gathered. Each round is written to the shared folder and
    replaces the one before.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    steps, before = Steps(edges.sparkSession, "edges"), None
    edges = steps.write(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = steps.write(large.where("u != v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = steps.write(small.distinct())
        now = one(edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
