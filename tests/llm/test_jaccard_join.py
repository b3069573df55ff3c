"""Components of the n-gram Jaccard join against brute force."""

import random
import re

import pytest

from tabstrata.llm import jaccard_join as J
from tabstrata.llm.common import components

DOCS = "doc_id bigint, text string, node string, n_shingles string, extra int"


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))}


def brute(docs, n=4, percent=85):
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(60))
    passage = [word() for _ in range(40)]
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 30, 60, 120]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    chain = [word() for _ in range(80)]  # neighbours link, ends do not
    for i in range(12):
        docs.append(" ".join(chain))
        chain[(7 * i) % 80] = word()
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "two words"), (1004, "Two\nWORDS"), (3, rows[3][1]), (None, rows[5][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], DOCS).repartition(5)
    got = J.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_lower_threshold_and_larger_shingles(spark):
    docs = corpus(3)
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], DOCS)
    got = J.jaccard_components(df, n=5, percent=80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 5, 80)


@pytest.mark.parametrize("chunk", [128, 3])
def test_links_of_each_document_like_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    docs = corpus(5)
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], DOCS).repartition(5)
    got = J.jaccard_components(df, links=True).select("doc_id", "component_id", "n_links").collect()
    sets = [shingles(t) for _, t in docs]
    near = lambda x, y: bool(x) and 100 * len(x & y) >= 85 * len(x | y)
    links = [sum(near(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == sorted(((d, k) for (d, _), k in zip(docs, links)), key=repr)
    assert max(links) > 3
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(((d, c) for d, _, c in brute(docs)), key=repr)


def test_one_document_of_each_component_stays(spark):
    docs = corpus(4)
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], DOCS)
    out = J.deduplicated(df)
    assert out.columns == df.columns
    want = {c for _, n, c in brute(docs) if n} | {1000, 1001, 1002}
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(want) and set(ids) == want


def test_different_texts_with_null_or_equal_ids_stay(spark):
    words = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(f"{w}{k}" for w in words) for k in range(6)]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (9, texts[4])]
    docs += [(7, texts[5]), (8, texts[5]), (7, texts[5])]
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], DOCS)
    got = sorted(((r.text, r.doc_id) for r in J.deduplicated(df).collect()), key=repr)
    assert got == sorted(zip(texts, [None, None, 7, 7, 9, 7]), key=repr)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    assert J.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    df = spark.createDataFrame(path + star + [(5, 5)], "a bigint, b bigint")
    got = dict(map(tuple, components(df).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(1000, 1100)}
