"""Targets and Pareto samples against plain versions."""

import hashlib
import math
import re

import pytest

from tabstrata.llm import mixing as M

SIZED = "doc_id bigint, source string, size bigint"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        share = (total - sum(most * sizes[s] for s in full)) / max(sum(w[s] for s in rest), 1)
        above = {s for s in rest if w[s] * share > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s]) if s in full else w[s] * share for s in names}
        full |= above


def plain_copies(rows, target, total):
    out = {}
    for source in target:
        own = [r for r in rows if r[1] == source]
        rate = target[source] / total[source] if total[source] else 0.0
        sure, p = math.floor(rate), rate - math.floor(rate)
        ranked = []
        for d, _, n in own:
            u = int(hashlib.md5(f"42|{'' if d is None else d}".encode()).hexdigest()[:8], 16) / 2**32
            if p > 0:
                q = (u / (1 - u)) / (p / (1 - p))
                ranked.append((q / (1 + q), -1 if d is None else d, n))
            out[d, source] = sure
        need, run = target[source] - sure * total[source], 0
        for _, d, n in sorted(ranked):
            if run + n <= need or (run < need and run + n - need <= need - run):
                out[None if d == -1 else d, source] += 1
            run += n
    return out


def table():
    rows = [(i, f"s{i % 5}", (i * 7919) % 400) for i in range(1500)]
    rows += [(2000 + i, "small", 3) for i in range(4)] + [(3000 + i, None, 50 + i) for i in range(30)]
    return rows + [(4000, "empty", 0), (None, "s1", 9)]


def test_targets(spark):
    sizes = {"b": 100, "a": 5, None: 40, "Z": 1000, "é": 3, "void": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.targets(df, [1, 2, 3]).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_copies_like_the_plain_version(spark):
    rows = table()
    df = spark.createDataFrame(rows, SIZED)
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + n
    target = plain_targets(total)
    got = M.copies(df, M.plan(df)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.source): r.copies for r in got} == plain_copies(rows, target, total)
    for s in total:
        taken = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(taken - target[s]) <= max(n for _, x, n in rows if x == s) / 2 + 1e-6
    again = M.copies(df.repartition(3), M.plan(df.repartition(7)))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_unequal_weights_prefer_heavy_documents(spark):
    rows = [(i, "a" if i % 3 else "b", 10, 4.0 if i % 2 else 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, SIZED + ", doc_weight double")
    got = M.copies(df, M.plan(df)).collect()
    mean = lambda odd: sum(r.copies for r in got if r.source == "a" and r.doc_id % 2 == odd) / 1000
    assert mean(1) > 2.5 * mean(0) > 0


def test_rows_of_the_mix(spark):
    rows = [(i, "a" if i < 50 else "b", " ".join("w" * (i % 9)), i) for i in range(100)] + [(100, "a", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size int")
    out = M.mixed(df)
    assert out.columns == df.columns
    assert all(r.text is None or re.fullmatch("(w( w)*)?", r.text) for r in out.collect())
    assert M.mixed(df.limit(0)).count() == 0


def test_words_are_counted(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc d ",)], "text string")
    assert [r[0] for r in df.select(M.n_words(df.text)).collect()] == [0, 0, 3]


def test_equal_and_null_ids_are_drawn_one_by_one(spark):
    """Sources whose ids are all null or equal reach their targets to half of a document, too."""
    rows = [(None, "a", f"w{i} x y z", i) for i in range(100)] + [(None, "c", "same text of five", 0)] * 60
    rows += [(7, "b", " ".join(["v"] * (1 + i % 4)), i) for i in range(90)] + [(i, "d", "q " * (i % 7), i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, nr int").repartition(5)
    total = {}
    for _, s, t, _ in rows:
        total[s] = total.get(s, 0) + len(t.split())
    target = plain_targets(total)
    out = [r for r in M.mixed(df).collect()]
    for s in total:
        taken = sum(len(r.text.split()) for r in out if r.source == s)
        assert abs(taken - target[s]) <= 3.5, (s, taken, target[s])
    again = M.mixed(df.repartition(2)).collect()
    key = lambda r: (r.source, str(r.doc_id), r.text)
    assert sorted(map(key, again)) == sorted(map(key, out))
    copies = {}
    for r in out:
        copies[r.source, r.nr] = copies.get((r.source, r.nr), 0) + 1
    # no row of a source stands there two times more often than another
    for s in ("a", "b"):
        found = [copies.get((s, i), 0) for i in range(100 if s == "a" else 90)]
        assert max(found) - min(found) <= 1
