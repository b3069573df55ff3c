"""Spelling variants: words that differ by one letter inserted, deleted or replaced, grouped under frequent forms.

Words are points, their letter counts. One replaced letter takes one count away and adds another, one
inserted letter adds one: an L1 distance of two at most. For each pair of lengths (L, L) and (L, L + 1) a
K-d tree over the counts of the longer words is searched by the shorter ones: boxes that lie more than one
added or one removed letter away are pruned, and what remains is verified on the order of the letters.

The tree has two levels. The upper one is fitted on a bounded sample of words (`SAMPLE`) of the lengths that
have more than `CELL` words; its leaves are cells. Every word is placed in one cell and sent as a search to the
cells its neighbours can be in. Each cell is one group of bounded size, in which the lower level is built over
all its words. Words with the same letters are one point; verification looks the possible spellings
up by hash, so anagrams, however many, are never compared with each other.

Scale: words are counted with map-side combination; only distinct words that are frequent enough are
indexed. Links are never gathered: each word keeps their number and its best one. Roots are found by doubling
pointers, in a number of joins that is logarithmic in the length of a chain, and counts double along it.

Cases: null and empty texts have no words; a null id counts as an empty one in what is perturbed; repeated
rows count each; equal numbers are decided by code points; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstrata.llm.common import one
from tabstrata.runtime import Steps, materialize

# Letters of words (fixed values): A-Z in lower case only, and U+00C0 to U+00FF.
RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_COLUMN = np.full(256, -1)
_COLUMN[np.frombuffer(LETTERS.encode("latin-1"), np.uint8)] = np.arange(len(LETTERS))

#: Words of one cell of the upper level, and words it is fitted on.
CELL, SAMPLE = 20_000, 200_000
#: Distinct points of a leaf of the lower level, searches that pass through a cell together.
LEAF, SEARCHES = 48, 20_000


def lower_runs(text: Column) -> Column:
    """One row per maximal run of letters, A-Z in lower case."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))
    return F.explode(F.transform(runs, lambda r: F.translate(r, LETTERS[:26].upper(), LETTERS[:26])))


def word_counts(docs: DataFrame, misspelt: int = 0, least_length: int = 5, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``least_length`` letters that occur ``least_n`` times.

    With ``misspelt`` = m, a run whose crc32 with its document's id is divisible by m loses one letter.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), lower_runs(F.col(text_col)).alias("word"))
    if misspelt:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "word").cast("binary"))
        at = F.pmod(h, F.char_length("word")).cast("int")
        left = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.pmod(h, F.lit(misspelt)) == 0, left).otherwise(F.col("word")).alias("word"))
    runs = runs.where(F.char_length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def letter_counts(words: list[str]) -> np.ndarray:
    """Row i counts the letters of word i."""
    size = np.array([len(w) for w in words], np.int64)
    letters = _COLUMN[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    if (letters < 0).any():
        raise ValueError("words consist of a-z and U+00C0 to U+00FF")
    at = np.repeat(np.arange(len(words)), size) * len(LETTERS) + letters
    counts = np.bincount(at, minlength=len(words) * len(LETTERS)).reshape(-1, len(LETTERS))
    return counts.astype(np.int16 if not len(size) or size.max() < 1 << 14 else np.int64)


class Tree:
    """K-d tree over rows of counts. A node is split on its most varying letter; a leaf keeps its rows.

    Boxes are those of the rows (``tight``), or, for an upper level fitted on a sample, the half spaces of the
    splits, so that rows outside the sample have a leaf as well.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool = True):
        self.nodes: list[tuple] = []  # (low, high, left, right, rows); left is -1 in a leaf
        self.leaves: list[int] = []
        width, top = points.shape[1], np.iinfo(points.dtype).max
        todo = [(np.arange(len(points)), np.zeros(width, points.dtype), np.full(width, top, points.dtype), -1, 0)]
        while todo:
            rows, low, high, parent, side = todo.pop()
            held, me = points[rows], len(self.nodes)
            if tight and len(rows):
                low, high = held.min(0), held.max(0)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[2 + side] = me
                self.nodes[parent] = tuple(node)
            spread = held.var(0) if len(rows) > leaf else np.zeros(width)
            letter = int(spread.argmax()) if len(spread) else 0
            if not len(spread) or spread[letter] == 0:
                self.nodes.append((low, high, -1, -1, rows))
                self.leaves.append(me)
                continue
            at = int(np.floor(held[:, letter].mean()))
            below, above = high.copy(), low.copy()
            below[letter], above[letter] = at, at + 1
            self.nodes.append((low, high, -2, -2, None))
            lower = held[:, letter] <= at
            todo += [(rows[lower], low, below, me, 0), (rows[~lower], above, high, me, 1)]
        self.number = {n: i for i, n in enumerate(self.leaves)}

    def search(self, points: np.ndarray, removed: int):
        """(leaf, rows) with the points that may reach a row of the leaf by one added and ``removed`` removed letters."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            me, rows = todo.pop()
            low, high, left, right, _ = self.nodes[me]
            q = points[rows]
            near = np.maximum(low - q, 0).sum(1) <= 1
            near &= np.maximum(q - high, 0).sum(1) <= removed
            rows = rows[near]
            if not len(rows):
                continue
            if left == -1:
                yield me, rows
            else:
                todo += [(left, rows), (right, rows)]

    def home(self, points: np.ndarray) -> np.ndarray:
        """Number of the leaf that each point lies in."""
        out = np.zeros(len(points), np.int64)
        for me, rows in self.search_inside(points):
            out[rows] = self.number[me]
        return out

    def search_inside(self, points: np.ndarray):
        todo = [(0, np.arange(len(points)))]
        while todo:
            me, rows = todo.pop()
            _, _, left, right, _ = self.nodes[me]
            if left == -1:
                yield me, rows
                continue
            low, high = self.nodes[left][:2]
            inside = ((points[rows] >= low) & (points[rows] <= high)).all(1)
            todo += [(left, rows[inside]), (right, rows[~inside])]


def upper_trees(words: DataFrame, cell: int, sample: int) -> dict[int, Tree]:
    """The upper level of each length with more than ``cell`` words, fitted on about ``sample`` words in all."""
    sizes = words.groupBy(F.char_length("word").alias("size")).agg(F.count("*").alias("n")).where(F.col("n") > cell)
    sizes = {r["size"]: r["n"] for r in sizes.collect()}  # at most one row for each `cell` words
    if not sizes:
        return {}
    share = min(1.0, sample / sum(sizes.values()))
    keep = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    found = words.where(keep & F.char_length("word").isin(list(sizes))).select("word").toArrow()["word"].to_pylist()
    leaf = max(int(cell * share), 16)
    by_size: dict[int, list[str]] = {}
    for w in found:
        by_size.setdefault(len(w), []).append(w)
    return {size: Tree(letter_counts(held), leaf, tight=False) for size, held in by_size.items()}


def routed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(size, cell, role, word, n): each word once in its cell (role 0), and as a search for words of its own length
    (role 1) and for words longer by one (role 2) in the cells that may hold some."""

    def send(batches):
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes, parts = np.array([len(w) for w in words], np.int64), []
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                points = letter_counts([words[i] for i in rows])
                for role, tree, target in ((0, trees.get(size), size), (1, trees.get(size), size), (2, trees.get(size + 1), size + 1)):
                    if tree is None:
                        found = [(0, np.arange(len(rows)))]
                    elif role == 0:
                        found = [(tree.number[leaf], at) for leaf, at in tree.search_inside(points)]
                    else:
                        found = [(tree.number[leaf], at) for leaf, at in tree.search(points, 2 - role)]
                    parts += [(target, c, role, rows[at]) for c, at in found]
            at = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.int64)
            size, cell, role = (np.repeat([p[k] for p in parts], [len(p[3]) for p in parts]) for k in range(3))
            yield pa.record_batch(
                [pa.array(size, pa.int32()), pa.array(cell, pa.int32()), pa.array(role, pa.int32()), batch.column(0).take(pa.array(at)), pa.array(n[at])],
                names=["size", "cell", "role", "word", "n"],
            )

    return words.select("word", "n").mapInArrow(send, "size int, cell int, role int, word string, n bigint")


def spellings(word: str, role: int, change: np.ndarray, both: bool = True):
    """Words that arise from ``word`` by the one change of letter counts that ``change`` shows."""
    new = LETTERS[int(change.argmax())]
    if role == 1:
        old, at = LETTERS[int(change.argmin())], -1
        if old < new:  # the other word of the pair would find the same
            while (at := word.find(old, at + 1)) >= 0:
                yield word[:at] + new + word[at + 1 :]
    else:
        for at in range(len(word) + 1):
            if at == len(word) or word[at] != new:  # before an equal letter it's the same as behind it
                yield word[:at] + new + word[at:]


def near_in_cell(words: list[str], searches: list[str], role: int) -> list[tuple[int, int]]:
    """(search, word) positions of near words; each pair is found from one of its sides."""
    position = {w: i for i, w in enumerate(words)}
    points = np.unique(letter_counts(words), axis=0)
    tree, out = Tree(points, LEAF), []
    for low in range(0, len(searches), SEARCHES):
        queries = letter_counts(searches[low : low + SEARCHES])
        for leaf, rows in tree.search(queries, 2 - role):
            held = points[tree.nodes[leaf][4]]
            for part in np.array_split(rows, len(rows) * len(held) // 200_000 + 1):
                change = held[None, :, :] - queries[part][:, None, :]
                found = np.nonzero(np.abs(change).sum(2) == (2 if role == 1 else 1))
                for i, c in zip(part[found[0]].tolist(), change[found]):
                    for s in spellings(searches[low + i], role, c):
                        if s in position:
                            out.append((low + i, position[s]))
    return out


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, near, near_n), in both directions, of all pairs of ``words`` (word, n) that differ by one letter."""

    def search(table: pa.Table) -> pa.Table:
        role, names, n = (table.column(c).to_numpy() for c in ("role", "word", "n"))
        held, held_n = names[role == 0].tolist(), n[role == 0]
        left, right, left_n, right_n = [], [], [], []
        for r in (1, 2):
            asked, asked_n = names[role == r].tolist(), n[role == r]
            for i, j in near_in_cell(held, asked, r) if held and asked else []:
                left += [asked[i], held[j]]
                right += [held[j], asked[i]]
                right_n += [held_n[j], asked_n[i]]
        return pa.table({"word": pa.array(left, pa.string()), "near": pa.array(right, pa.string()), "near_n": pa.array(right_n, pa.int64())})

    cells = routed(words, upper_trees(words, cell, sample))
    return cells.groupBy("size", "cell").applyInArrow(search, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of ``forms`` (word, form): where following the forms ends. Forms have no cycles."""
    steps = Steps(forms.sparkSession, "roots")
    now = steps.write(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = steps.write(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().cast("int").alias("moved")))
        if not one(now.agg(F.max("moved").alias("m")))["m"]:
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, ratio: int = 2, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), which are distinct.

    The form of a word is its near word of largest n, the first by code points among several, if that is at
    least ``ratio`` times (over 1) the word's own n.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best")
    near = near_words(words, cell, sample).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.select("word", "n").join(near, "word", "left")
    is_form = -F.col("best.least") >= ratio * F.col("n")
    joined = joined.select(
        "word",
        F.when(is_form, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, -F.col("best.least")).alias("form_n"),
    )
    table = materialize(joined, "forms")
    ends = roots(table.where("form is not null"))
    found = table.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, misspelt: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`variants` of the words of ``docs``."""
    return variants(materialize(word_counts(docs, misspelt, id_col=id_col, text_col=text_col), "words"))
