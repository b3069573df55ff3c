"""The pipeline's stages: what each keeps, and what they return."""

import corpus_pipeline as P
from test_jaccard_join import brute as components

from tabstrata.llm import decontaminate as D

MEDIUM = "/root/testdata/sf0.01"


def test_every_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in P.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, seen[-1], MEDIUM).write.parquet(path)
        seen.append(spark.read.parquet(path))
    assert all(x.columns == columns for x in seen[:-1])
    rows = [x.select("doc_id", "text").collect() for x in seen[:-1]] + [seen[-1].collect()]
    ids = [[r.doc_id for r in x] for x in rows]
    assert set(ids[1]) <= set(ids[0]) and len(ids[1]) >= 0.97 * len(ids[0])
    found = components([(r.doc_id, r.text) for r in rows[1]])
    assert sorted(ids[2]) == sorted({c for _, n, c in found if n} | {d for d, n, _ in found if not n})
    windows = set()
    for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect():
        w = D.words_of((r.text or "").encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    clean = []
    for r in rows[2]:
        w = D.words_of((r.text or "").encode())
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.append(r.doc_id)
    assert sorted(ids[3]) == sorted(clean)
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in set(ids[4])) <= 3
    assert sorted(ids[5]) == sorted(ids[4])
    shards = {(r.shard, r.slot) for r in rows[5]}
    assert len(shards) == len(ids[5])


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, MEDIUM).count() == 0
