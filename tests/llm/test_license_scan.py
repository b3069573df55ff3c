"""License scans against exact containment in every stretch of words."""

import random
import re

import pytest

from tabstrata.llm import license_scan as S

DOCS = "doc_id bigint, text string, licenses string"


def shingles(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_planted_notices_are_found(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(99)) for _ in range(n))
    names, docs, want = sorted(S.TEMPLATES), [], {}
    for i in range(300):
        parts, planted = [filler(rng.randrange(200))], []
        for _ in range(i % 3):
            name = rng.choice(names)
            parts += [S.TEMPLATES[name].upper(), filler(rng.randrange(60))]
            planted.append(name)
        docs.append((i, " ".join(parts), "x"))
        want[i] = planted
    docs += [(900, None, "x"), (901, "", "x"), (902, "one two", "x"), (903, filler(150_000) + " " + S.TEMPLATES["mit"], "x"), docs[4]]
    want |= {900: [], 901: [], 902: [], 903: ["mit"]}
    got = S.scan(spark.createDataFrame(docs, DOCS).repartition(4)).collect()
    assert len(got) == len(docs)
    texts = {d: set(shingles(t or "")) for d, t, _ in docs}
    for r in got:
        assert set(want[r.doc_id]) <= set(r.licenses) and r.licenses == sorted(set(r.licenses))
        assert r.n_matches == len(r.licenses) == len(r.containment)
        for name, share in zip(r.licenses, r.containment):
            own = set(shingles(S.TEMPLATES[name]))
            assert 0.8 <= share <= len(own & texts[r.doc_id]) / len(own) + 1e-9


def test_changed_words(spark):
    text = S.TEMPLATES["mit-header"].replace("charge", "cost", 1)
    own = set(shingles(S.TEMPLATES["mit-header"]))
    share = len(own & set(shingles(text))) / len(own)
    rows = [(1, "x y z " * 30 + text, "a")]
    assert S.scan(spark.createDataFrame(rows, DOCS), threshold=share - 0.01).first().licenses == ["mit-header"]
    assert S.scan(spark.createDataFrame(rows, DOCS), threshold=share + 0.01).first().licenses == []


def test_bands_guarantee_collision():
    index = S.TemplateIndex(S.TEMPLATES, 0.8, 0.9999)
    for size, window, seeds, _, _, sets in index.classes:
        least = min(0.8 * len(s) / (window + 0.2 * len(s)) for s in sets)
        assert 1 - (1 - least) ** len(seeds) >= 0.9999


def test_short_templates_and_empty_tables(spark):
    with pytest.raises(ValueError):
        S.TemplateIndex({"x": "too short"}, 0.8, 0.99)
    empty = spark.createDataFrame([], DOCS)
    assert S.scan(empty).count() == 0
    assert S.scan(spark.createDataFrame([(1, "a b c d e", "x")], DOCS), templates={}).first().n_matches == 0
