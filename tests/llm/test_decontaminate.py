"""The automaton against a plain search for windows; cutting and dropping; odd inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabstrata.llm import decontaminate as D

DOCS = "doc_id bigint, text string, extra string, hit_spans string"
ITEMS = "item_id bigint, text string"


def brute(text, items, window):
    words = D.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        own = D.words_of((t or "").encode())
        n = min(len(own), window)
        for i in range(len(own) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(item)
    return len(words), len(hit), found


def random_case(seed, window):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "é"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([0, 1, 2, window - 1, window, 12])))) for i in range(6)]
    docs = []
    for d in range(40):
        words = some(rng.randrange(30))
        if d % 3 == 0:
            words += rng.choice(items)[1].split()
        docs.append((d, " ".join(words).upper() if d % 2 else ", ".join(words), "x", "clash"))
    docs += [(100, None, None, None), (101, "", "", ""), (102, docs[0][1], "x", "y"), (102, docs[0][1], "x", "y")]
    return docs, items


@pytest.mark.parametrize("seed,window,max_words", [(1, 3, 1000), (2, 4, 1000), (3, 4, 7), (4, 10, 1)])
def test_like_brute_force(spark, seed, window, max_words):
    docs, items = random_case(seed, window)
    got = D.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window, max_words).collect()
    assert len(got) == len(docs)
    texts = {d[0]: d[1] for d in docs}
    for row in got:
        n, hit, found = brute(texts[row.doc_id], items, window)
        listed = ",".join(sorted(map(str, found)))
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n, hit, len(found), hit > 0)
        assert row.items_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_no_items_and_no_documents(spark):
    docs, items = random_case(1, 3)
    none = spark.createDataFrame([], ITEMS)
    got = D.report(spark.createDataFrame(docs, DOCS), none).agg(F.sum("n_hit"), F.sum("n_words")).first()
    assert got[0] == 0 and got[1] > 0
    assert D.report(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_spans_are_cut_and_covered_documents_dropped(spark):
    item = "one two three four five"
    docs = [
        (1, f"Keep this, please: {item}! And all the rest of this text, too, which is long enough.", 0),
        (2, item.upper(), 0),
        (3, "nothing to see", 7),
        (4, None, None),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint")
    items = spark.createDataFrame([(1, item)], ITEMS)
    got = {r.doc_id: r for r in D.decontaminate(df, items, window=4, max_span=4, max_coverage=0.5).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == "Keep this, please: ! And all the rest of this text, too, which is long enough."
    assert got[1].n_chars == len(got[1].text)
    assert (got[3].text, got[3].n_chars) == ("nothing to see", 7)
    strict = D.decontaminate(df, items, window=4, max_coverage=0.0)
    assert {r.doc_id for r in strict.collect()} == {3, 4} and strict.columns == df.columns


def test_a_very_long_text(spark):
    text = "w " * 300_000 + "one two three four"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = D.report(df, spark.createDataFrame([(9, "one two three four")], ITEMS), window=4).first()
    assert (row.n_words, row.n_hit, row.n_items) == (300_004, 4, 1)


def test_columns_named_like_results_come_back_untouched(spark):
    quoted = " ".join(f"w{i}" for i in range(10))
    rows = [(1, f"before {quoted} " + "x " * 60 + "after", "own", [7], 5), (2, "clean", "kept", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, hit_words string, hit_spans array<int>, hit_items int")
    bench = spark.createDataFrame([(1, quoted)], "item_id bigint, text string")
    got = D.decontaminate(docs, bench)
    assert got.columns == docs.columns
    got = {r.doc_id: r for r in got.collect()}
    assert (got[1].hit_words, got[1].hit_spans, got[1].hit_items) == ("own", [7], 5) and quoted not in got[1].text
    assert got[2] == docs.where("doc_id = 2").first()
