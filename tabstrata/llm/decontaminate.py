"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of every training text are streamed through the automaton, which tracks the longest
run ending at each word that occurs in an item. Words inside a run of ``window`` words (or inside
a whole item that is shorter) are hit; spans of hit words, their share of the text and the items
found decide what is cut or dropped.

Scale: documents are read once and never shuffled. The items are spread over automata of at most
``max_words`` words (plus one item); each is built and broadcast on its own, so neither driver nor
executors hold more than that, and documents pass through one automaton after the other.

Cases: a null or empty text has no words and is never hit; an item without words is ignored;
repeated items count each by its own id; items with a null id are matched but not listed; without
items nothing is hit; equal rows give equal results; `decontaminate` keeps further columns whatever
their names, `hits` those that aren't named like its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstrata.llm.common import bounded_batches

WINDOW = 10
#: Words in one automaton; it takes about 0.6 kB a word in a Python worker.
MAX_WORDS = 200_000
#: Columns that `hits` adds.
HITS = ("hit_spans", "hit_items", "hit_words")

#: Lower-cases A-Z and turns all bytes that belong to no word into blanks; UTF-8 above 0x7F stays.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of every window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, ids in known:
            at = 0
            for c in ids:
                at = self._extend(at, c)
        n = len(self.next)
        #: state holding the last ``window`` words of a state's runs; -1 if its runs are shorter
        self.tail = [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.link[s]
                self.tail[s] = s if self.length[up] < window else self.tail[up]
        self.items: dict[int, set] = {}
        self.short: dict[int, tuple[int, set]] = {}
        for item, ids in known:
            s = 0
            for k, c in enumerate(ids):
                s = self.next[s][c]
                if k + 1 >= window:
                    self.items.setdefault(self.tail[s], set()).add(item)
            if len(ids) < window:
                self.short.setdefault(s, (len(ids), set()))[1].add(item)
        #: nearest state, upwards from a state, that ends a short item
        self.ends = [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.ends[s] = s if s in self.short else self.ends[self.link[s]]

    def _copy(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [a, b) of hit words, and the items found."""
        step, link, length, tail, ends = self.next, self.link, self.length, self.tail, self.ends
        window, any_short = self.window, bool(self.short)
        spans: list[tuple[int, int]] = []
        found_tails: set = set()
        found: set = set()
        s = run = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                s = run = 0
                continue
            t = step[s].get(c)
            if t is None:
                while s and t is None:
                    s = link[s]
                    t = step[s].get(c)
                run = length[s]
                if t is None:
                    run = s = 0
                    continue
            s = t
            run += 1
            a = i + 1
            if run >= window:
                # the state may also stand for longer runs, but its last words are the same
                found_tails.add(tail[s])
                a = i + 1 - window
            elif any_short and ends[s] >= 0:
                pass
            else:
                continue
            if any_short:
                e = ends[s]
                while e > 0:
                    n, items = self.short[e]
                    if n <= run:
                        found |= items
                        a = min(a, i + 1 - n)
                    e = ends[link[e]]
            if a <= i:
                while spans and a <= spans[-1][1]:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        for t in found_tails:
            found |= self.items[t]
        return spans, found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(benchmark: DataFrame, window: int, max_words: int):
    """Automata over parts of the items; the driver holds one part at a time."""
    part, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words = words_of(bytes(row[1] or b""))
        if part and size + len(words) > max_words:
            yield Automaton(part, window)
            part, size = [], 0
        part.append((row[0], words))
        size += len(words)
    if part:
        yield Automaton(part, window)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` plus ``hit_spans`` (array of [first, end) word positions), ``hit_items`` (sorted item
    ids as strings) and ``hit_words`` (all words of the text), in place of columns of these names."""
    docs = docs.drop(*HITS)
    spark = bounded_batches(docs).sparkSession
    extra = "hit_spans array<int>, hit_items array<string>, hit_words bigint"
    out = docs.select(
        "*",
        F.array().cast("array<int>").alias("hit_spans"),
        F.array().cast("array<string>").alias("hit_items"),
        F.lit(0).cast("long").alias("hit_words"),
    )
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(extra).fields)
    made = False
    for automaton in automata(benchmark, window, max_words):
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(automaton)), schema)
        made = True
    if not made:  # no items: only the words are counted
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(Automaton([], window))), schema)
    return out


def _scanner(shared):
    def task(batches):
        automaton = shared.value
        for batch in batches:
            n = batch.num_columns - 3
            old_spans = batch.column(n).to_pylist()
            old_items = batch.column(n + 1).to_pylist()
            texts = batch.column(batch.schema.get_field_index("text")).fill_null("").cast(pa.binary())
            spans_out, items_out, counts = [], [], np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(texts):
                words = words_of(text.as_py())
                spans, found = automaton.scan(words)
                if old_spans[i]:
                    spans = _merge(spans + list(zip(old_spans[i][::2], old_spans[i][1::2])))
                spans_out.append([x for s in spans for x in s])
                items_out.append(sorted({*(x for x in found if x is not None), *old_items[i]}))
                counts[i] = len(words)
            columns = [*batch.columns[:n], pa.array(spans_out, pa.list_(pa.int32()))]
            columns += [pa.array(items_out, pa.list_(pa.string())), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return task


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    ``n_items`` counts item ids, so an id that stands on several rows counts once.
    """
    found = hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window, max_words)
    # spans are stored as first, end, first, end, ...: ends count plus, firsts minus
    n_hit = F.aggregate(
        F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, b: a + b
    )
    return found.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_span: int = WINDOW,
    max_coverage: float = 0.3,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``docs`` without contaminated text, same columns.

    Spans of at least ``max_span`` hit words, and every span of a text whose share of hit words
    exceeds ``max_coverage``, are contaminated; a text over the coverage limit is dropped, from any
    other the contaminated spans are cut out, from the first byte of their first word to the last
    byte of their last. With ``max_coverage=0`` every contaminated document is dropped. A column
    ``n_chars`` is set to the new length. Other rows stay as they are.
    """
    names = docs.columns
    # columns named like those of `hits` are carried under other names; rows are put together by position
    found = hits(docs.withColumnsRenamed({c: f"__in_{c}" for c in HITS}), benchmark, window, max_words)

    def cut(batches):
        for batch in batches:
            rows = batch.num_rows
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            spans_of, words_n = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            keep, changed = np.ones(rows, bool), {}
            for i, flat in enumerate(spans_of):
                if not flat:
                    continue
                spans = list(zip(flat[::2], flat[1::2]))
                if sum(b - a for a, b in spans) > max_coverage * words_n[i]:
                    keep[i] = False
                    continue
                spans = [s for s in spans if s[1] - s[0] >= max_span]
                if spans:
                    changed[i] = cut_spans(texts[i], spans)
            columns = list(batch.columns[: len(names)])
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.string())
                if "n_chars" in names:
                    k = names.index("n_chars")
                    sizes = columns[k].to_pylist()
                    columns[k] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(sizes)], columns[k].type)
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out if keep.all() else out.filter(pa.array(keep))

    return found.mapInArrow(cut, docs.schema)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``."""
    raw = text.encode()
    letters = np.frombuffer(raw.translate(TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letters, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()
