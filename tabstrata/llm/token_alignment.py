"""Alignment of the tokens of two tokenizers, with the document frequencies of the linked pairs.

Both vocabularies cut the same bytes, a blank and the text. All tokens of both are sorted by start; where a
start reaches the running maximum of the ends, both have ended, and a group begins. Inside the groups all
tokens whose byte ranges overlap are linked. Texts are cut into pieces at blanks where both always end
(`pieces`), so each distinct piece of a batch is encoded and aligned once.

An id pair counts once for each document that holds it linked. Counts are a map-side combined aggregate
over the vocabulary of pairs, which does not grow with the number of documents beyond what the two
vocabularies can form; they meet the documents again through a broadcast of checked size, or beyond it by a
join on salted pairs.

Scale: one pass encodes the texts and writes, next to the results of each document, its distinct pairs and
how often each is linked, to the shared folder; counting and adding up read only that. Texts are never
shuffled, and without more than ``broadcast_pairs`` distinct pairs neither are documents.

Cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens and
zeros everywhere, with an empty hash; ids may be null or repeated, each row is a document of its own; an
empty table gives an empty one; other columns, also those named like results, are left behind.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstrata.llm.common import bounded_batches, runs_of, slices, text_buffer
from tabstrata.llm.pieces import Pieces, by_bytes
from tabstrata.llm.token_counts import CALL, Counter, tokenizer_path
from tabstrata.runtime import materialize

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs whose counts are broadcast, 12 bytes each.
BROADCAST_PAIRS = 4_000_000
SALTS = 64
#: Pieces whose group strings are joined and hashed at a time.
HASHED = 100_000
#: Bytes of text aligned together, and characters of pieces that a worker remembers before it starts anew; no
#: result depends on them.
TOGETHER, REMEMBERED = 2 << 20, 6 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    added = {t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max(ids.values()) + 1)
    for entry, i in ids.items():
        out[i] = entry.encode() if i in added else bytes(map(alphabet.__getitem__, entry))
    return out


def piece_tokens(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: the blank mark is a blank, byte entries are their byte."""
    out = []
    for i in range(model.get_piece_size()):
        entry = model.id_to_piece(i)
        out.append(bytes([int(entry[3:5], 16)]) if model.is_byte(i) else entry.replace("▁", " ").encode())
    return out


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two sequences of intervals that cover the same bytes without gaps, and their overlapping pairs.

    Returns the group of each A interval and of each B interval, and the linked (A, B) positions.
    """
    n = len(a_end)
    end = np.concatenate([a_end, b_end])
    start = np.concatenate([[0], a_end[:-1], [0], b_end[:-1]]) if len(end) else end
    side = np.arange(len(end)) >= n
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(end), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(end), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = np.searchsorted(b_end, start[:n], side="right")
    count = np.searchsorted(start[n:], a_end, side="left") - first
    left = np.repeat(np.arange(n), count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return group[:n], group[n:], left, right


class Aligner:
    """Encodes and aligns texts with a byte-level .json (A) and a sentencepiece .model (B)."""

    def __init__(self, a_path: str, b_path: str, pair_type=np.int64):
        self.pair_type = pair_type
        self.a, self.b = Counter(a_path), Counter(b_path)
        if not (self.a.safe and self.b.prefixed):
            raise ValueError("alignment takes a byte-level .json and a .model with blank marks in front only")
        self.a.tokenizer.encode_special_tokens = True
        self.a_bytes, self.b_bytes = byte_level_tokens(a_path), piece_tokens(self.b.tokenizer)
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        self.bits = max(len(self.b_bytes) - 1, 1).bit_length()
        self.blank = self.b.tokenizer.piece_to_id("▁")
        self.forget()

    def encoded(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a, b = [], []
        for run in by_bytes(pieces, CALL):
            a += [e.ids for e in self.a.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
            b += self.b.tokenizer.encode([t[1:] for t in run], num_threads=1)
        return a, [[self.blank] if t == " " else ids for t, ids in zip(pieces, b)]

    def learn(self, pieces: list[str]) -> None:
        """Aligns pieces not met before."""
        a, b = self.encoded(pieces)
        bad = np.zeros(len(pieces), bool)
        for i, t in enumerate(pieces):
            raw = t.encode()
            bad[i] = not b"".join([self.a_bytes[x] for x in a[i]]) == raw == b"".join([self.b_bytes[x] for x in b[i]])
            if bad[i]:
                a[i], b[i] = [], []
        a_at, b_at = (np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) for ids in (a, b))
        a_id, b_id = (np.array([x for xs in ids for x in xs], np.int64) for ids in (a, b))
        a_group, b_group, left, right = overlaps(np.cumsum(self.a_size[a_id]), np.cumsum(self.b_size[b_id]))
        links_at = np.searchsorted(left, a_at)
        groups_at = np.append(a_group, a_group[-1] + 1 if len(a_group) else 0)[a_at]
        listed = _group_strings(a_id, b_id, a_group, b_group)
        self.strings += [";".join(listed[x:y]) for x, y in zip(groups_at[:-1].tolist(), groups_at[1:].tolist())]
        values = np.stack([bad, *(np.diff(at) for at in (a_at, b_at, groups_at, links_at))]).astype(np.int64)
        self.values = np.concatenate([self.values, values], axis=1)
        self.links = np.concatenate([self.links, (a_id[left] << self.bits) + b_id[right]])
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.held += sum(map(len, pieces))

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.strings: list[str] = []
        #: bad (1 if a tokenizer changes the bytes), n_a, n_b, n_groups, n_links of each piece, and their linked pairs
        self.values, self.links, self.held = np.zeros((5, 0), np.int64), np.zeros(0, np.int64), 0

    def aligned(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Results of each text, and its distinct pairs (A id * 2 ** bits + B id) with their numbers of links."""
        empty = np.asarray(pc.equal(pc.binary_length(texts.fill_null("")), 0))
        pieces = Pieces(pc.binary_join_element_wise("", texts.fill_null(""), " "))
        if self.held > REMEMBERED:
            self.forget()
        new = [t for t in pieces.distinct if t not in self.number]
        if new:
            self.learn(new)
        pieces.codes = np.array([self.number[t] for t in pieces.distinct], np.int64)[pieces.codes]
        bad, *sums = (pieces.summed(v) for v in self.values)
        kept = ~empty & (bad == 0)
        out = {name: pa.array(np.where(kept, v, 0)) for name, v in zip(("n_a", "n_b", "n_groups", "n_links"), sums)}
        out["groups_sha256"] = pa.array(_hashes(pieces, self.strings, kept), pa.string())
        pairs, times, at = self._pairs(pieces, kept)
        out["pairs"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(pairs))
        out["times"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(times))
        return out

    def _pairs(self, pieces: Pieces, kept: np.ndarray):
        """Distinct pairs of each text, sorted, with their numbers, and where those of each text begin."""
        text = np.repeat(np.arange(len(pieces)), np.diff(pieces.at))
        held = np.sort((text * len(self.number) + pieces.codes)[kept[text]])
        runs = runs_of(held)
        text, piece = np.divmod(held[runs[:-1]], max(len(self.number), 1))
        size, links_at = self.values[4][piece], np.cumsum(self.values[4]) - self.values[4]
        index = np.arange(size.sum()) + np.repeat(links_at[piece] - (np.cumsum(size) - size), size)
        text, pair, times = np.repeat(text, size), self.links[index], np.repeat(np.diff(runs), size)
        order = np.lexsort((pair, text))
        text, pair, times = text[order], pair[order], times[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
        where = np.flatnonzero(first)
        times = np.add.reduceat(times, where) if len(where) else times
        return pair[where].astype(self.pair_type), times.astype(np.int32), np.searchsorted(text[where], np.arange(len(pieces) + 1))


@functools.lru_cache(1)
def aligner_of(a_path: str, b_path: str, narrow: bool) -> Aligner:
    """The worker's aligner; what it remembers serves its later tasks as well."""
    return Aligner(a_path, b_path, np.int32 if narrow else np.int64)


def _group_strings(a_id, b_id, a_group, b_group) -> list[str]:
    """``a1,a2|b1`` of each group."""
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    sides = []
    for ids, group in ((a_id, a_group), (b_id, b_group)):
        text, at = list(map(str, ids.tolist())), np.searchsorted(group, np.arange(n + 1)).tolist()
        sides.append([text[x] if y - x == 1 else ",".join(text[x:y]) for x, y in zip(at[:-1], at[1:])])
    return [f"{x}|{y}" for x, y in zip(*sides)]


def _hashes(pieces: Pieces, strings: list[str], kept: np.ndarray) -> list[str]:
    out = []
    for i, ok in enumerate(kept.tolist()):
        if not ok:
            out.append("")
            continue
        digest, low, high = hashlib.sha256(), int(pieces.at[i]), int(pieces.at[i + 1])
        for x in range(low, high, HASHED):
            some = ";".join(map(strings.__getitem__, pieces.codes[x : min(x + HASHED, high)].tolist()))
            digest.update((some if x == low else ";" + some).encode())
        out.append(digest.hexdigest())
    return out


def b_bits(b: str = B) -> int:
    """Bits of an id of B inside a pair."""
    return max(len(piece_tokens(Counter(tokenizer_path(b)).tokenizer)) - 1, 1).bit_length()


def link_table(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row of ``docs``.

    ``pairs`` are the distinct linked ids of a text, A id * 2 ** bits + B id, ``times`` how often each is linked.
    """
    a_path, b_path = tokenizer_path(a), tokenizer_path(b)
    narrow = len(byte_level_tokens(a_path)) << b_bits(b) < 1 << 31

    def align(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        aligner, n = aligner_of(a_path, b_path, narrow), TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high in slices(text_buffer(batch.column(1))[1], TOGETHER):
                part = batch.slice(low, high - low)
                rows = pa.array(np.arange(n, n + part.num_rows))
                found = {"row": rows, "id": part.column(0)} | aligner.aligned(part.column(1))
                n += part.num_rows
                yield pa.record_batch(list(found.values()), names=list(found))

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (
        f"row bigint, id {pair.schema['id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, "
        f"n_links bigint, groups_sha256 string, pairs array<{'int' if narrow else 'bigint'}>, times array<int>"
    )
    return bounded_batches(pair).mapInArrow(align, schema)


def pair_counts(links: DataFrame, bits: int) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked, and whether no pair of the same A id has more."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = counts.groupBy(F.shiftright("pair", bits).alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", F.shiftright("pair", bits))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def weighed(links: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``links`` without pairs, with n_best and count_sum; ``counts`` are broadcast only when they are few."""
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        return _weighed_by_broadcast(links, counts)
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    each = each.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    each = each.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))  # a pair may be in most documents
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = each.join(salted, ["pair", "salt"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("n_best"),
        F.sum(F.col("n") * F.col("times")).cast("bigint").alias("count_sum"),
    )
    return links.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def _weighed_by_broadcast(links: DataFrame, counts: DataFrame) -> DataFrame:
    kept = [c for c in links.columns if c not in ("pairs", "times")]
    table = counts.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    known = (table["pair"].to_numpy()[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order])
    known = links.sparkSession.sparkContext.broadcast(known)

    def weigh(batches):
        pairs, n, best = known.value
        for batch in batches:
            held, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).flatten().to_numpy()
            at = held.offsets.to_numpy().astype(np.int64) - held.offsets[0].as_py()
            found = np.searchsorted(pairs, held.flatten().to_numpy())
            sums = [np.concatenate([[0], np.cumsum(times * x[found], dtype=np.int64)]) for x in (best, n)]
            columns = batch.columns[:-2] + [pa.array(x[at[1:]] - x[at[:-1]]) for x in sums]
            yield pa.record_batch(columns, names=[*kept, "n_best", "count_sum"])

    fields = ", ".join(f"`{c}` {links.schema[c].dataType.simpleString()}" for c in kept)
    return links.select(*kept, "pairs", "times").mapInArrow(weigh, f"{fields}, n_best bigint, count_sum bigint")


def alignment(
    docs: DataFrame,
    a: str = A,
    b: str = B,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    links = materialize(link_table(docs, a, b, id_col, text_col), "links")
    counts = materialize(pair_counts(links, b_bits(b)), "pair-counts")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return weighed(links, counts, broadcast_pairs).select(F.col("id").alias(id_col), *names)
