"""Spelling variants against a plain version that tries every edit of every word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabstrata.llm import spelling as S

DOCS = "doc_id bigint, text string, word string, n int"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted(docs, misspelt):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, UPPER.lower()))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misspelt and h % misspelt == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def edits(w):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    for c in S.LETTERS:
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1)} | {w[:i] + c + w[i + 1 :] for i in range(len(w))}
    return out - {w}


def plain(words):
    form, rows = {}, []
    near = {w: [x for x in edits(w) if x in words] for w in words}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-words[x], x))
            if words[best] >= 2 * words[w]:
                form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: r[0])


def test_documents(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, "Straße STRASSE straße straßen " * 3), (None, None), (5, ""), docs[0], docs[0], (6, "éàè×÷ " * 4 + "abcdef " * 20_000)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3)
    got = S.spelling_variants(frame, misspelt=7)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = ordered(plain(counted(docs, 7)))
    assert ordered(got.collect()) == want
    assert len({r[2] for r in want}) < len(want) and any(r[1] not in (None, r[2]) for r in want)


def random_words(seed, n, letters, sizes):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice([3, 3, 4, 7, 15, 40]) for _ in range(n)}


@pytest.mark.parametrize("letters,cell,sample", [("abc", 10, 50), ("abcdefgh", 40, 300), ("abcdefghijé×", 25, 10_000)])
def test_many_cells_and_anagrams(spark, letters, cell, sample):
    words = random_words(len(letters), 1500, letters, (5, 6, 7))
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert len(S.upper_trees(frame, cell, sample)) >= 2
    assert ordered(S.variants(frame, cell=cell, sample=sample).collect()) == ordered(plain(words))


def test_long_chain_and_long_words(spark):
    chain = {"a" * i + "bcdefgh"[: 12 - i]: 3 * 2**i for i in range(5, 10)}
    words = {w: n for w, n in chain.items()} | {"x" * 20_000: 3, "x" * 20_001: 9}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r.word: r for r in S.variants(frame).collect()}
    for w, form, root, n, _, form_n in plain({k: v for k, v in words.items() if len(k) < 50}):
        assert (got[w].form, got[w].root, got[w].n, got[w].form_n) == (form, root, n, form_n)
    assert got["x" * 20_000].form == "x" * 20_001


def test_roots_of_a_chain(spark):
    frame = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("u", "w30")], "word string, form string")
    assert {r.root for r in S.roots(frame).collect()} == {"w37"}


def test_tree_keeps_every_row():
    points = S.letter_counts(list(random_words(3, 3000, "abcdef", (6,))))
    tree = S.Tree(points, 20)
    assert sorted(np.concatenate([tree.nodes[i][4] for i in tree.leaves]).tolist()) == list(range(len(points)))
    upper = S.Tree(points[:200], 20, tight=False)
    home = upper.home(points)
    reached = {(i, upper.number[leaf]) for leaf, rows in upper.search(points, 1) for i in rows.tolist()}
    assert all((i, h) in reached for i, h in enumerate(home.tolist())) and len(set(home.tolist())) == len(upper.leaves)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.spelling_variants(empty).collect() == []
    assert S.spelling_variants(spark.createDataFrame([(1, None), (2, "rare words")], "doc_id bigint, text string")).collect() == []
    with pytest.raises(ValueError):
        S.letter_counts(["Upper"])
