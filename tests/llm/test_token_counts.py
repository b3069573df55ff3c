"""Token counts against the libraries on whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabstrata.llm import token_counts as C
from tabstrata.llm.pieces import Pieces, by_bytes

PARTS = ["a", "b'", "'s", " ", "  ", "\n", " ", "　", "é", "\x85", "\x1c", "<|endoftext|>", "<s>", "▁", "12", "!?", "漢", " ", "\x00", "👍", "<0x41>"]
FILES = ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


def plain(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        t = Tokenizer.from_file(path)
        return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    texts = odd_texts(3000) + ["", " ", "  ", "▁ ", "a "]
    assert C.Counter(C.tokenizer_path(name)).counts(pa.array(texts)).tolist() == plain(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_documents_with_nulls_and_clashing_columns(spark, small, name):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()[:60]]
    docs += [(None, "a null id"), (7, None), (7, ""), docs[0], (8, "x" * 30_000 + " word" * 40_000)]
    frame = spark.createDataFrame([(*d, 1, 2, "z") for d in docs], "doc_id bigint, text string, n_tokens int, id int, n_bytes string")
    got = sorted(map(tuple, C.token_counts(frame.repartition(3), name, limit=100).collect()), key=repr)
    counts = plain(name, [t or "" for _, t in docs])
    want = [(d, len((t or "").encode()), n, n > 100) for (d, t), n in zip(docs, counts)]
    assert got == sorted(want, key=repr)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 50)
    monkeypatch.setattr(C, "CALL", 7)
    counter, texts = C.Counter(C.tokenizer_path(FILES[0])), odd_texts(400, 2)
    got = [n for i in range(0, 400, 50) for n in counter.counts(pa.array(texts[i : i + 50]))]
    assert got == plain(FILES[0], texts)


def test_pieces_are_the_texts():
    texts = odd_texts(2000, 3) + [None]
    p = Pieces(pa.array(texts))
    assert ["".join(p.distinct[c] for c in p.codes[x:y]) for x, y in zip(p.at[:-1], p.at[1:])] == [t or "" for t in texts]
    assert [len(p), len(Pieces(pa.array([], pa.string())))] == [2001, 0]


def test_runs_are_balanced():
    runs = list(by_bytes(["ab", "c", "d" * 9, "", "e"], 3))
    assert runs == [["ab", "c"], ["d" * 9], ["", "e"]] and list(by_bytes([], 3)) == []


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert C.token_counts(empty).collect() == []
    assert C.token_counts(empty).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    with pytest.raises(ValueError):
        C.Counter("/x/other.txt")
