"""Token counts of texts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is bounded by bytes. Its texts, however long, are cut at boundaries that are safe for the
tokenizer (`pieces`), each distinct piece is encoded once, in calls of about the same number of bytes, and
lengths are added up by text. A tokenizer for which no safe boundary is known encodes whole texts, in calls
balanced in the same way. Ids of tokens never leave the call that made them.

Scale: one pass without a shuffle; a worker holds the tokenizer, one batch and the encoding of one call.

Cases: a null or empty text has no bytes and no tokens; ids may be null or repeated, each row is counted;
an empty table gives an empty one; other columns, also those named like results, are left behind.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.llm.common import bounded_batches, text_buffer
from tabstrata.llm.pieces import Pieces, by_bytes

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters in one call of the tokenizer.
CALL = 256 << 10
#: Characters of pieces whose lengths a worker remembers before it starts anew; no result depends on it.
REMEMBERED = 8 << 20


def tokenizer_path(name: str) -> str:
    """Where ``name`` is: a path as it stands, or a file of the package of public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Lengths of encodings, by the library that belongs to the file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            split = spec.get("pre_tokenizer") or {}
            plain = all(not t["lstrip"] and not t["rstrip"] and not any(map(str.isspace, t["content"])) for t in spec["added_tokens"])
            self.safe = bool(
                spec.get("normalizer") is None
                and split.get("type") == "ByteLevel"
                and split.get("use_regex")
                and not split.get("add_prefix_space")
                and plain
            )
            self.prefixed = False
        elif path.endswith(".model"):
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
            self.safe = self.prefixed = marks_in_front(self.tokenizer)
        else:
            raise ValueError(f"{path}: neither a .json nor a .model file")
        self.known: dict[str, int] = {}
        self.held = 0

    def lengths(self, texts: list[str]) -> list[int]:
        if not hasattr(self.tokenizer, "encode_batch"):
            return [len(ids) for ids in self.tokenizer.encode(texts, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column."""
        if not self.safe:
            texts = column.fill_null("").to_pylist()
            return np.array([n for run in by_bytes(texts, CALL) for n in self.lengths(run)], np.int64)
        if self.prefixed:  # the blank that the model would put before a text is put here, and taken from each piece
            column = pc.binary_join_element_wise("", column.fill_null(""), " ", null_handling="replace")
        pieces = Pieces(column)
        total = pieces.summed(self.remembered(pieces.distinct))
        return np.where(np.asarray(pc.equal(column, " ")), 0, total) if self.prefixed else total

    def remembered(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece; those met before are not encoded again."""
        new = [t for t in pieces if t not in self.known]
        if self.held > REMEMBERED:
            self.known, self.held, new = {}, 0, pieces
        for run in by_bytes(new, CALL):
            self.known.update(zip(run, self.lengths([t[1:] for t in run] if self.prefixed else run)))
        if self.prefixed and " " in self.known:
            self.known[" "] = 1  # a lone blank at the end of a text
        self.held += sum(map(len, new))
        return np.array([self.known[t] for t in pieces], np.int64)


@functools.lru_cache(1)
def counter_of(path: str) -> Counter:
    """The worker's counter; what it remembers serves its later tasks as well."""
    return Counter(path)


def marks_in_front(model) -> bool:
    """True when no entry of a sentencepiece vocabulary has the blank mark after another character, and a blank
    is put before each text and none is taken away."""
    entries = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = model.encode("a") != model.encode(" a") and len(model.encode("a  ")) > len(model.encode("a"))
    return kept and not any("▁" in e.lstrip("▁") for e in entries) and model.piece_to_id("▁") != model.unk_id()


def token_counts(
    docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``, without added special tokens or truncation."""
    path = tokenizer_path(tokenizer)

    def count(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        counter = counter_of(path)
        for batch in batches:
            text = batch.column(1)
            _, offsets = text_buffer(text)
            tokens = counter.counts(text)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens)], names=["id", "n_bytes", "n_tokens"])

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {pair.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    found = bounded_batches(pair).mapInArrow(count, schema)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
