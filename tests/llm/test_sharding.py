"""Shards against the best contiguous partition found by plain search."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabstrata.llm import sharding as S

DOCS = "doc_id bigint, text string, shard string, slot string, key string"


def best(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, now = (low + high) // 2, 1, 0
        for s in sizes:
            if now + s > mid:
                used, now = used + 1, 0
            now += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("n,shards,bins", [(600, 24, 4096), (600, 7, 8), (5, 24, 4096), (1, 24, 4)])
def test_least_capacity(spark, monkeypatch, n, shards, bins):
    monkeypatch.setattr(S, "BINS", bins)
    monkeypatch.setattr(S, "FINER", 4)
    rng = random.Random(n)
    texts = [f"t{i} " * rng.choice([1, 2, 50, 400]) for i in range(n)]
    docs = [(i, rng.choice(texts)) for i in range(2 * n)] + [(9000 + i, texts[0]) for i in range(n)]
    if n > 1:
        docs += [(1, None), (2, None), (3, ""), (3, ""), (None, "é")]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], DOCS)
    got = S.shards(df, shards).collect()
    assert len(got) == len(docs)
    groups = {}
    for _, t in docs:
        key = hashlib.md5((t or "").encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 8
    loads, slots, where = {}, {}, {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert max(loads.values()) == best([groups[k] for k in sorted(groups)], shards)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in where.values())
    assert set(loads) <= set(range(shards))
    crcs = sorted(zlib.crc32((t or "").encode()) for _, t in docs)
    assert sorted(r.text_crc32 for r in got) == crcs
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)


@pytest.mark.parametrize("hot,bins", [([3000], 4096), ([300_000], 8), ([2000, 900], 64), ([], 8)])
def test_all_shards_are_used_evenly_beside_hot_groups(spark, monkeypatch, hot, bins):
    monkeypatch.setattr(S, "BINS", bins)
    monkeypatch.setattr(S, "FINER", 4)
    docs = [(i, f"text {i:05d}") for i in range(6000)]
    docs += [(10_000 + i, f"hot copy {k}") for k, n in enumerate(hot) for i in range(n)]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], DOCS)
    loads = {r.shard: r.n for r in S.shards(df).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    groups = {}
    for _, t in docs:
        key = hashlib.md5(t.encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len(t) + 8
    assert set(loads) == set(range(24)) and max(loads.values()) == best([groups[k] for k in sorted(groups)], 24)
    # stretches between hot groups have whole numbers of shards
    assert min(loads.values()) >= 0.6 * 6000 * 18 / (24 - len(hot))


def test_few_or_uneven_groups(spark):
    for n, shards in [(24, 24), (25, 24), (30, 24), (3, 2)]:
        docs = [(i, f"{i} " * (1 + 40 * (i % 7 == 0)), "x", "y", "z") for i in range(n)]
        docs += [docs[3]] * 500 if n > 3 else []
        got = S.shards(spark.createDataFrame(docs, DOCS), shards).collect()
        assert len(got) == len(docs) and {r.shard for r in got} == set(range(shards))


def test_empty_table(spark):
    assert S.shards(spark.createDataFrame([], DOCS)).count() == 0
