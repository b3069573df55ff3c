"""Token alignment against a plain version over whole texts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from test_token_counts import odd_texts
from tokenizers import Tokenizer

from tabstrata.llm import token_alignment as T

DOCS = "doc_id bigint, text string, n_a string, row int, pairs int"


def plain(texts):
    """Results of each text, one token after the other."""
    a_tok = Tokenizer.from_file(public_tokenizers.path(T.A))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.B))
    a_bytes = T.byte_level_tokens(public_tokenizers.path(T.A))

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        m = re.fullmatch(r"<0x([0-9A-F]{2})>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    docs, seen = [], Counter()
    for text in texts:
        whole = " " + (text or "")
        a, b = a_tok.encode(whole, add_special_tokens=False).ids, b_tok.encode(text or "")
        same = b"".join(a_bytes[i] for i in a) == whole.encode() == b"".join(map(b_bytes, b))
        if not text or not same:
            docs.append(None)
            continue
        ends = [list(np.cumsum([len(x) for x in xs])) for xs in ([a_bytes[i] for i in a], [b_bytes(i) for i in b])]
        common, groups, links, i, j = sorted(set(ends[0]) & set(ends[1])), [], [], 0, 0
        for c in common:
            x, y = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append((a[i:x], b[j:y]))
            for p in range(i, x):
                for q in range(j, y):
                    low = max(ends[0][p - 1] if p else 0, ends[1][q - 1] if q else 0)
                    if low < min(ends[0][p], ends[1][q]):
                        links.append((a[p], b[q]))
            i, j = x, y
        docs.append((a, b, groups, links))
        seen.update(set(links))
    most = defaultdict(int)
    for (a, _), n in seen.items():
        most[a] = max(most[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(seen[x] == most[x[0]] for x in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(seen[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def check(spark, docs, **options):
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS).repartition(3)
    got = T.alignment(frame, **options)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(d, *row) for (d, _), row in zip(docs, plain([t for _, t in docs]))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_documents_and_odd_texts(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").collect()[:80]]
    docs += [(1000 + i, t) for i, t in enumerate(odd_texts(300, 5))]
    docs += [(None, "a null id"), (None, None), (3, ""), (3, " "), (3, "a "), docs[0], docs[0], (4, "▁ x"), (5, "<s> <|endoftext|> <unk>")]
    check(spark, docs)
    check(spark, docs, broadcast_pairs=10)


def test_long_text_and_hashing_in_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "HASHED", 7)
    aligner = T.Aligner(public_tokenizers.path(T.A), public_tokenizers.path(T.B))
    import pyarrow as pa

    texts = ["word " * 300 + "x" * 500, "some, other\nwords  here" * 9]
    got, want = aligner.aligned(pa.array(texts)), plain(texts)
    assert got["groups_sha256"].to_pylist() == [w[6] for w in want]
    assert got["n_links"].to_pylist() == [w[3] for w in want]


def test_forgetting_changes_nothing(spark, monkeypatch):
    aligner = T.Aligner(public_tokenizers.path(T.A), public_tokenizers.path(T.B))
    monkeypatch.setattr(T, "REMEMBERED", 30)
    import pyarrow as pa

    texts = odd_texts(60, 8)
    got = [r for i in range(0, 60, 5) for r in aligner.aligned(pa.array(texts[i : i + 5]))["groups_sha256"].to_pylist()]
    assert got == [w[6] for w in plain(texts)]


def test_overlaps_by_hand():
    a_group, b_group, left, right = T.overlaps(np.array([3, 5, 6]), np.array([2, 5, 6]))
    assert a_group.tolist() == b_group.tolist() == [0, 0, 1]
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert T.alignment(empty).collect() == []
    rows = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")
    assert [tuple(r)[1:] for r in T.alignment(rows).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
