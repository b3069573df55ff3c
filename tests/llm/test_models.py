"""Language, toxicity and language-model scores: held-out quality, exact sums, odd inputs."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstrata.llm import lattice_lm as LM
from tabstrata.llm import language_id as LI
from tabstrata.llm import queries as Q
from tabstrata.llm import toxicity as TX

MEDIUM = "/root/testdata/sf0.01"


def crc(d, n):
    return zlib.crc32(str(d).encode()) % n


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = Q.op7_language_id(spark, MEDIUM).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_language_cases(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", 0.5) for i in range(40)]
    rows += [(100, None, "en", 1.0), (101, "", "en", 1.0), (102, "12 !? 3", "de", 1.0), (103, "the", None, 1.0), (104, "a", "xx", 1.0)]
    rows += [(105, "the dog " * 200_000, None, 1.0), (106, "é", None, 1.0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_score double")
    model = LI.fit(df, F.col("doc_id") < 100)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in LI.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert (got[103].lang_pred, got[105].lang_pred) == ("en", "en") and got[106].lang_pred in model.languages
    kept = LI.identified(df, model)
    assert kept.columns == df.columns and {100, 101, 102}.isdisjoint({r.doc_id for r in kept.collect()})
    none = LI.fit(df, F.lit(False))
    assert {r.lang_pred for r in LI.predict(df, none).collect()} == {"und"}
    only = LI.fit(df, F.col("lang") == "en")
    assert LI.predict(df.where("doc_id = 0"), only).first().lang_pred == "en"
    assert LI.predict(df.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [2, 3, 5, 9, 40])
def test_codewords_are_apart(n):
    code = LI.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n == 2 else 2 if n == 3 else 5)


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = Q.op8_toxicity(spark, MEDIUM).collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_cases(spark):
    docs = [(1, None, "x"), (2, "", "y"), (3, "You idiot", "z"), (3, "You idiot", "z"), (4, "a " * 200_000, "z")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, hits string")
    labels = spark.createDataFrame([(3, 1), (4, None), (9, 0)], "doc_id bigint, toxic int")
    got = TX.score(df, labels, F.lit(True)).collect()
    assert len(got) == 5 and {r.toxicity for r in got} == {1.0}
    none = TX.score(df, labels.limit(0), F.lit(True)).collect()
    assert {r.toxicity for r in none} == {0.0}
    assert TX.score(df.limit(0), labels, F.lit(True)).count() == 0


def test_features():
    lexicon = TX.Lexicon({b"idiot": 2.0}, {b"lowei": 1.0})
    row = dict(zip(TX.FEATURES, lexicon.features(b"You 1D10T! loweitzer x.y fine")))
    assert row["hits"] == 2 and row["near_you"] > 0 and row["obfuscated"] > 0 and row["marks"] > 0
    assert lexicon.features(b"") == [0.0] * len(TX.FEATURES)


def all_segmentations(word, logp):
    if not word:
        return 1.0
    return sum(math.exp(logp[word[:k]]) * all_segmentations(word[k:], logp) for k in range(1, len(word) + 1) if word[:k] in logp)


def test_forward_sums_all_segmentations():
    names = [b" a", b" ", b"a", b"b", b"ab", b"ba", b"bab", b" ab"]
    keys = LM.piece_keys(names)
    order = np.argsort(keys)
    names = [names[i] for i in order]
    pieces = LM.Pieces(names, keys[order], np.arange(1.0, 9.0))
    for word in (b"a", b"b", b"abab", b"babba"):
        want = math.log(all_segmentations(b" " + word, pieces.by_piece()))
        assert pieces.forward(np.frombuffer(b" " + word, np.uint8)[None, :])[0] == pytest.approx(want)
        assert pieces.forward_one(word) == pytest.approx(want)
    sums = np.zeros(len(names))
    pieces.expected(np.frombuffer(b" ab", np.uint8)[None, :], np.ones(1), sums)
    assert sum(s * len(p) for s, p in zip(sums, names)) == pytest.approx(3)  # a segmentation covers the word


def test_long_words_take_part_in_the_estimation(spark):
    names = [b" a", b" ", b"a", b"b", b"ab", b"ba", b"bab", b" ab"]
    keys = LM.piece_keys(names)
    order = np.argsort(keys)
    pieces = LM.Pieces([names[i] for i in order], keys[order], np.arange(1.0, 9.0))
    for word in (b"a", b"babba", b"ab" * 50):
        want, got = np.zeros(8), np.zeros(8)
        pieces.expected(np.frombuffer(b" " + word, np.uint8)[None, :], np.ones(1), want)
        pieces.expected_one(word, got)
        assert got == pytest.approx(want)
    words = spark.createDataFrame([(bytearray(b"zqzq" * 30),), (bytearray("語".encode() * 40),)], "word binary")
    none = LM.estimate(words.limit(0), rounds=1)
    learned = LM.estimate(words, rounds=1)
    for piece in (b"q", "語".encode()):
        i = learned.by_index()[piece]
        assert learned.logp[i] > none.logp[i]


def test_scores_like_a_plain_version(spark):
    rows = [(i, "The cat sat " * (i % 5) + f"word{i}", "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "é" * 90 + " a", "x"), (7, rows[7][1], "x"), (7, "unseen", "x"), (None, "cat", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(3)
    learn = Q.crc_mod(F.col("doc_id"), 7) != 2
    got = LM.scores(df, learn).collect()
    assert len(got) == len(rows)
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _, _ in rows}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    counts = {}
    for d, t, _ in rows:
        if not held[d]:
            for w in [*words(t), None]:
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, t, _ in rows:
        c = [counts.get(w, 0) for w in [*words(t), None]]
        base = sum(math.log10((x + 1) / (total + distinct + 1)) for x in c)
        want.append((str(d), len(c), sum(x > 0 for x in c), round(base, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)
    assert {r.train_tokens for r in got} == {total} and all(r.held_out == held[r.doc_id] for r in got)
    assert all(r.score < 0 for r in got)
    short = {r.doc_id: r.score for r in got}
    assert short[101] == short[100] > short[102]


def test_rare_and_common_words_give_the_same_sums(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = Q.crc_mod(F.col("doc_id"), 7) != 2
    a = {r.doc_id: (r.n_known, r.base_score) for r in LM.scores(df, learn, rounds=0).collect()}
    monkeypatch.setattr(LM, "HEAD", 20)
    b = {r.doc_id: (r.n_known, r.base_score) for r in LM.scores(df, learn, rounds=0).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert all(abs(a[k][1] - b[k][1]) < 1e-6 * abs(a[k][1]) for k in a)


def test_lm_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert LM.scores(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    row = LM.scores(one, F.lit(False)).first()
    assert (row.n_known, row.train_tokens, row.n_tokens, row.held_out) == (0, 0, 3, True)


def test_identified_keeps_columns_named_like_results(spark):
    rows = [(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * 8, "de" if i % 2 else "en", "own", 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, ambiguous string, lang_score int")
    kept = LI.identified(docs, LI.fit(docs, F.lit(True)))
    assert kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect())) == sorted(rows)


def plain_scores(rows, pieces, held):
    """Log10 probabilities of the texts in ``rows`` (id, text, class), word by word and class by class."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    classes = sorted({k or "" for d, _, k in rows if not held[d]})
    counts = {k: {} for k in classes}
    docs = dict.fromkeys(classes, 0)
    for d, t, k in rows:
        if not held[d]:
            docs[k or ""] += 1
            for w in words(t):
                counts[k or ""][w] = counts[k or ""].get(w, 0) + 1
    total = {}
    for own in counts.values():
        for w, c in own.items():
            total[w] = total.get(w, 0) + c
    once, twice = (sum(c == x for c in total.values()) for x in (1, 2))
    less = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
    out = []
    for d, t, _ in rows:
        paths = []
        for k in classes:
            n = sum(counts[k].values())
            end = (docs[k] + 1) / (n + docs[k] + 2)
            x = math.log((docs[k] + 0.5) / (sum(docs.values()) + 0.5 * len(classes))) + math.log(end)
            for w in words(t):
                lattice = math.exp(pieces.forward_one(w.encode()))
                p = (max(counts[k].get(w, 0) - less, 0) + less * len(counts[k]) * lattice) / n if n else lattice
                x += math.log(p) + math.log(1 - end)
            paths.append(x)
        top = max(paths)
        out.append((str(d), round((top + math.log(sum(math.exp(x - top) for x in paths))) / math.log(10), 4)))
    return sorted(out)


@pytest.mark.parametrize("head,block,docs", [(200_000, 1 << 20, 1 << 15), (20, 40, 1 << 15), (20, 1 << 20, 7)])
def test_delivered_scores_are_those_of_a_plain_version(spark, monkeypatch, head, block, docs):
    rows = [(i, "the cat sat " * (i % 5) + f"word{i % 23} x{i}", ("a", "b", None)[i % 3]) for i in range(90)]
    rows += [(100, None, "a"), (101, "", "c"), (102, "unseen cat", "zz"), (7, rows[7][1], "a"), (103, "the only " * 40, "d")]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _, _ in rows}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    learn = Q.crc_mod(F.col("doc_id"), 7) != 2
    words = LM.count_words(df.where(learn).select("text"))
    pieces = LM.estimate(words, rounds=1)
    monkeypatch.setattr(LM, "HEAD", head)
    monkeypatch.setattr(LM, "BLOCK", block)
    monkeypatch.setattr(LM, "PACKET_DOCS", docs)
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in LM.scores(df, learn, kind="lang", rounds=1).collect())
    want = plain_scores(rows, pieces, held)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=2e-4)


def test_further_classes_share_one(spark):
    rows = [(i, f"word{i % 9} tail{i}", f"k{i % 70:02d}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    pooled = [(d, t, "~" if int(k[1:]) >= 63 else k) for d, t, k in rows]  # ten classes have a row more and come first
    pieces = LM.estimate(LM.count_words(df.select("text")), rounds=0)
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in LM.scores(df, F.lit(True), kind="lang", rounds=0).collect())
    want = plain_scores(pooled, pieces, dict.fromkeys(range(150), False))
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=2e-4)


def test_toxicity_keeps_columns_named_like_features(spark):
    docs = [(i, "you idiot" if i % 2 else "a fine day", f"l{i}", i) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, length string, hits int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0)):
        got = TX.score(df, known, F.lit(True))
        assert got.columns == ["doc_id", "length", "hits", "features", "toxicity"]
        assert {(r.doc_id, r.length, r.hits) for r in got.collect()} == {(i, f"l{i}", i) for i in range(60)}
