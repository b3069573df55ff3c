"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte trigrams
tells the languages with a 1 from those with a 0: naive Bayes log ratios of the trigram shares. A
text is decoded to the language whose codeword has the least loss, the logistic losses of the bits
being weighted by how well the bit separates the languages; close decisions are flagged.

Scale: training is one pass over all training texts that returns one row of counts per task and
language; prediction is a second pass without shuffle. The model is languages x buckets numbers; the
number of languages is checked.

Cases: null texts and texts without letters are ``und`` with score 0 and flagged; rows with a null
language are predicted but not learned from; with one known language it is predicted for all, with
none all are ``und``; equal losses go to the first language in order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstrata.llm.common import bounded_batches, slices, text_buffer
from tabstrata.runtime import small_rows

BUCKETS = 1 << 13
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Letters in lower case; all other ASCII is a gap.
_FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32
)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte; the last two have none."""
    b = _FOLD[data]
    h = (b[:-2] * np.uint32(256) + b[1:-1]) * np.uint32(256) + b[2:]
    h *= np.uint32(2654435761)
    return (h >> np.uint32(32 - 13)).astype(np.int64)


def trigram_counts(column):
    """Blocks of (first row, rows x buckets counts as float32)."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        base = int(offsets[a])
        part = data[base : int(offsets[b])]
        grams = _trigrams(part) if len(part) > 2 else np.zeros(0, np.int64)
        for x in range(a, b, 256):
            y = min(x + 256, b)
            out = np.zeros((y - x, BUCKETS), np.float32)
            for i in range(x, y):
                s, e = int(offsets[i]) - base, int(offsets[i + 1]) - base
                if e - s >= 3:
                    out[i - x] = np.bincount(grams[s : e - 2], minlength=BUCKETS)
                elif e > s:
                    short = np.concatenate([[32], part[s:e], [32]]).astype(np.uint8)
                    out[i - x] = np.bincount(_trigrams(short), minlength=BUCKETS)
            yield x, out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 / -1: all splits of the languages up to five of them, else the random code
    whose least distance is greatest among 200 draws of 12 log2(n) bits."""
    if n <= 5:
        splits = [m for m in range(1, 1 << (n - 1))] if n > 1 else [1]
        return np.array([[1 if (m << 1 >> (n - 1 - i)) & 1 else -1 for m in splits] for i in range(n)])
    rng, best, most = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(12 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1, 1], size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=int) * bits
        if apart.min() > most:
            best, most = code, int(apart.min())
    return best


class LanguageModel:
    """Codewords, trigram weights of each bit, weights of the bits."""

    def __init__(self, languages: list[str], shares: np.ndarray):
        self.languages = languages
        if not languages:
            return
        self.code = codewords(len(languages))
        floor = 0.05 / BUCKETS
        shares = (shares + floor) / (shares + floor).sum(axis=1, keepdims=True)
        weights, reach = [], []
        for bit in self.code.T:
            one = shares[bit > 0].mean(axis=0) if (bit > 0).any() else np.full(BUCKETS, 1 / BUCKETS)
            none = shares[bit < 0].mean(axis=0) if (bit < 0).any() else np.full(BUCKETS, 1 / BUCKETS)
            w = np.log(one) - np.log(none)
            weights.append(w)
            reach.append(max(float((shares @ w * bit).min()), 1e-3))
        # a typical text of a language is expected at margin 4 on its weakest side of a bit
        self.weights = (np.array(weights).T * (4.0 / np.array(reach))).astype(np.float32)
        self.bit_weight = np.sqrt(reach) / np.sqrt(reach).sum()

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score, and the gap to the next."""
        margin = (counts @ self.weights) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        margin = np.clip(margin, -8, 8)
        loss = np.stack([(np.log1p(np.exp(-margin * c)) * self.bit_weight).sum(axis=1) for c in self.code], axis=1)
        odds = np.exp(-4.0 * (loss - loss.min(axis=1, keepdims=True)))
        p = odds / odds.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        rest = p.copy()
        rest[np.arange(len(p)), best] = 0
        return best, score, score - rest.max(axis=1)


def fit(docs: DataFrame, learn: Column) -> LanguageModel:
    """Learns from ``text`` and ``lang`` of the rows where ``learn`` holds, over all of them.

    A text counts by its trigram shares, with the weight of at most 500 trigrams.
    """
    rows = bounded_batches(docs).where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def task(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = np.array(batch.column(0).to_pylist(), object)
            for x, counts in trigram_counts(batch.column(1)):
                total = counts.sum(axis=1, keepdims=True)
                shares = counts * (np.minimum(total, 500) / np.maximum(total, 1))
                here = languages[x : x + len(counts)]
                for language in set(here):
                    add = shares[here == language].sum(axis=0, dtype=np.float64)
                    sums[language] = sums.get(language, 0) + add
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            names=["lang", "sums"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS)
        for v in table.column("sums"):
            total += np.frombuffer(v.as_buffer(), np.float64)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "sums": [total.tobytes()]})

    sums = rows.mapInArrow(task, "lang string, sums binary").groupBy("lang").applyInArrow(add, "lang string, sums binary")
    found = sorted(small_rows(sums, MAX_LANGUAGES, "languages"), key=lambda r: r["lang"])
    found = [(r["lang"], np.frombuffer(r["sums"], np.float64)) for r in found]
    found = [(k, v / v.sum()) for k, v in found if v.sum() > 0]
    return LanguageModel([k for k, _ in found], np.array([v for _, v in found]).reshape(len(found), BUCKETS))


def predict(docs: DataFrame, model: LanguageModel, least_gap: float = 0.2) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``lang_score`` (0 to 1) and ``ambiguous`` (gap to the next language
    below ``least_gap``, or no language at all)."""
    extra = "lang_pred string, lang_score double, ambiguous boolean"
    docs = bounded_batches(docs).drop("lang_pred", "lang_score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            n = batch.num_rows
            column = batch.column(batch.schema.get_field_index("text"))
            best, score, gap = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if len(names):
                for x, counts in trigram_counts(column):
                    part = slice(x, x + len(counts))
                    best[part], score[part], gap[part] = model.decode(counts)
            known = np.array([bool(len(names)) and t is not None and bool(_LETTER.search(t)) for t in column.to_pylist()], bool)
            pred = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
            added = [pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (gap < least_gap))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "lang_score", "ambiguous"]
            )

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(extra).fields]))


def identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows of no language: no letters, or flagged with a score below ``least_score``."""
    # columns are carried under other names, so that none is taken for a result
    carried = {c: c if c == "text" else f"__in_{i}" for i, c in enumerate(docs.columns)}
    found = predict(docs.withColumnsRenamed(carried), model)
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("ambiguous") & (F.col("lang_score") < least_score))
    return found.where(~rejected).select(*[F.col(a).alias(c) for c, a in carried.items()])
