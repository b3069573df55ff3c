"""Language-model scores by subword lattices: all segmentations of a word count.

An existing subword vocabulary gives the pieces and, by its scores, their prior weights. Their
probabilities are estimated on the distinct words of the training texts by expectation maximisation: each
round sums the expected uses of every piece over all segmentations. The lattice probability of a word is
the forward sum, in log space, over its segmentations. A word of the training texts is one more arc of its
own lattice: its count c less a discount d stands for itself, and the discounts of all V words are what
the pieces share, p(word) = ((c - d)+ + d * V * lattice(word)) / N. A text is its words and one end.
Training texts may be of several classes (languages): each has its own counts, a path through the lattice of a
text begins with the choice of a class, and the marginal sums over the classes, too. Beside it stands
an add-one unigram model of whole words (``base``).

Scale: training words are counted in a table on the shared folder, which grows with the corpus;
rounds sum one number per piece. Words frequent enough that at most ``HEAD`` can be so are broadcast
with their counts. The documents that a task reads together form a packet of a bounded number of (document, word) pairs: each
other word is sent once a packet to the block of its hash, the block adds the counts of all packets and answers each with
the counts of its words, and the pairs wait for the answer in the packet. So what is shuffled grows with the pairs
at a few bytes each, and nothing but word counts is written. Nothing else crosses the driver.

Cases: a null text is empty and scores as the end alone; without training rows the pieces keep their
prior and all counts are 0; a null class is a class; beyond ``MAX_KINDS`` classes the smallest ones, ties by name, share
the counts of one class; rows with equal ids are scored one by one; bytes outside the vocabulary
have pieces of their own; words of any length are handled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstrata.llm.common import (
    _P,
    _P_INV,
    Words,
    bounded_batches,
    mix,
    one,
    packed,
    power_of_two,
    powers,
    runs_of,
    slices,
    text_buffer,
    unpacked,
)
from tabstrata.runtime import materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words with at least 1 / HEAD of all training tokens are looked up in a broadcast table.
HEAD = 200_000
#: Classes with counts of their own; all smaller ones together are the last of them.
MAX_KINDS = 64
#: Pairs of a document and a rarer word in one packet, about, and in one block of hashes.
BLOCK = 1 << 20
#: Documents in one packet, about.
PACKET_DOCS = 1 << 15
#: Partitions of an exchange at most.
MAX_PARTS = 1 << 14
#: Words longer than this go one by one.
LONG = 64
_LENGTHS = mix(np.arange(LONG + 2, dtype=np.uint64) + np.uint64(0xA24BAED4963EE407))
_MARK = 32  # stands for the word start in front of a word; no word contains it


def vocabulary(path: str = VOCABULARY) -> list[tuple[bytes, float]]:
    """(bytes, prior weight) of the pieces of a sentencepiece file that words can contain.

    The weight is 1 / (rank + 10), the rank being that of the piece's score; all single bytes and the
    word start are there.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            scored.append((bytes([int(model.id_to_piece(i)[3:5], 16)]), model.get_score(i), True))
            continue
        piece = model.id_to_piece(i)
        raw = piece.replace("▁", " ").encode()
        if b" " in raw[1:] or any(65 <= c <= 90 for c in raw):
            continue
        scored.append((raw, model.get_score(i), False))
    ranked = sorted((x for x in scored if not x[2]), key=lambda x: (-x[1], x[0]))
    weights = {raw: 1.0 / (rank + 10) for rank, (raw, _, _) in enumerate(ranked)}
    least = 0.01 / (len(ranked) + 10)
    for c in range(256):
        weights.setdefault(bytes([c]), least)
    return sorted(weights.items())


def piece_keys(pieces: list[bytes]) -> np.ndarray:
    """A 64-bit key per piece, the same as that of a stretch of a word in ``Pieces.arcs``."""
    keys = np.zeros(len(pieces), np.uint64)
    length = np.array([len(p) for p in pieces])
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        b = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8).reshape(len(rows), n)
        raw = ((b.astype(np.uint64) + np.uint64(1)) * powers(_P, n)).sum(axis=1, dtype=np.uint64)
        keys[rows] = mix(raw + _LENGTHS[min(n, LONG + 1)])
    return keys


class Pieces:
    """A hash table of pieces with their natural log probabilities.

    Pieces are sorted by their keys. Their probabilities sum to one, and so do the lattice
    probabilities of all words: one piece with the word start, then any number of others.
    """

    def __init__(self, pieces: list[bytes], keys: np.ndarray, weights: np.ndarray):
        self.pieces, self.keys, self.longest = pieces, keys, max(map(len, pieces))
        with np.errstate(divide="ignore"):
            self.logp = np.log(weights / weights.sum())
        bits = max(len(pieces) * 4, 2).bit_length()
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece of each key, or -1."""
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        rows = np.flatnonzero(at < end)
        while len(rows):
            hit = self.keys[at[rows]] == keys[rows]
            out[rows[hit]] = at[rows[hit]]
            rows = rows[~hit]
            at[rows] += 1
            rows = rows[at[rows] < end[rows]]
        return out

    def arcs(self, words: np.ndarray):
        """(start, end, rows, pieces) of the lattice arcs of equally long words."""
        n, length = words.shape
        sums = np.zeros((length + 1, n), np.uint64)
        np.cumsum((words.T.astype(np.uint64) + np.uint64(1)) * powers(_P, length)[:, None], axis=0, out=sums[1:])
        back = powers(_P_INV, length)
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                found = self.find(mix((sums[j] - sums[i]) * back[i] + _LENGTHS[j - i]))
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    yield i, j, rows, found[rows]

    def forward(self, words: np.ndarray) -> np.ndarray:
        """Natural log probability of equally long words: the sum over all segmentations."""
        n, length = words.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, found in self.arcs(words):
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[found])
        return alpha[length]

    def expected(self, words: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Adds the expected uses of each piece in equally long words."""
        n, length = words.shape
        alpha = np.full((length + 1, n), -np.inf)
        beta = np.full((length + 1, n), -np.inf)
        alpha[0] = beta[length] = 0.0
        arcs = list(self.arcs(words))
        for i, j, rows, found in arcs:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[found])
        for i, j, rows, found in sorted(arcs, key=lambda a: -a[0]):
            beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + self.logp[found])
        used = [np.exp(alpha[i, r] + self.logp[f] + beta[j, r] - alpha[length, r]) * counts[r] for i, j, r, f in arcs]
        sums += np.bincount(np.concatenate([a[3] for a in arcs]), np.concatenate(used), len(sums))

    def forward_one(self, word: bytes) -> float:
        """The same for one word of any length."""
        known = self.by_piece()
        word = bytes([_MARK]) + word
        alpha = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            starts = range(max(0, j - self.longest), j)
            parts = np.array([alpha[i] + known[word[i:j]] for i in starts if word[i:j] in known])
            top = parts.max()
            alpha[j] = top + float(np.log(np.exp(parts - top).sum()))
        return alpha[-1]

    def expected_one(self, word: bytes, sums: np.ndarray) -> None:
        """Adds the expected uses of each piece in one word of any length."""
        known, index = self.by_piece(), self.by_index()
        word = bytes([_MARK]) + word
        n = len(word)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for j in range(1, n + 1):
            starts = [i for i in range(max(0, j - self.longest), j) if word[i:j] in known]
            if starts:
                alpha[j] = np.logaddexp.reduce(alpha[starts] + np.array([known[word[i:j]] for i in starts]))
        for i in range(n - 1, -1, -1):
            ends = [j for j in range(i + 1, min(i + self.longest, n) + 1) if word[i:j] in known]
            if ends:
                paths = beta[ends] + np.array([known[word[i:j]] for j in ends])
                beta[i] = np.logaddexp.reduce(paths)
                sums[[index[word[i:j]] for j in ends]] += np.exp(alpha[i] + paths - alpha[n])

    def by_index(self) -> dict[bytes, int]:
        if not hasattr(self, "_by_index"):
            self._by_index = {p: i for i, p in enumerate(self.pieces)}
        return self._by_index

    def by_piece(self) -> dict[bytes, float]:
        if not hasattr(self, "_by_piece"):
            self._by_piece = {p: float(x) for p, x in zip(self.pieces, self.logp)}
        return self._by_piece


def by_length(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 20_000):
    """(rows, matrix of marked words) for words of equal length, up to LONG bytes."""
    length = end - start
    order = np.argsort(length, kind="stable")
    cuts = runs_of(length[order])
    for a, b in zip(cuts[:-1], cuts[1:]):
        n = int(length[order[a]])
        if n > LONG:
            return
        for x in range(a, b, most):
            rows = order[x : min(x + most, b)]
            out = np.full((len(rows), n + 1), _MARK, np.uint8)
            out[:, 1:] = data[start[rows][:, None] + np.arange(n)]
            yield rows, out


def log_probabilities(pieces: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start))
    for rows, words in by_length(data, start, end):
        out[rows] = pieces.forward(words)
    for i in np.flatnonzero(end - start > LONG):
        out[i] = pieces.forward_one(data[start[i] : end[i]].tobytes())
    return out


def count_words(docs: DataFrame, classes: int = 1) -> DataFrame:
    """(word, c0, c1, ...): how often each word stands in the texts of each class.

    ``docs`` has text and, if there are several classes, their number in ``kind``.
    """

    def task(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            kinds = batch.column(1).to_numpy()
            for a, b in slices(offsets, 4 << 20):
                words = Words(data, offsets[a : b + 1])
                _, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
                kind = np.repeat(kinds[a:b], np.diff(words.at))
                pairs, count = np.unique(inverse * classes + kind, return_counts=True)
                at = first[pairs // classes]
                raw = words.bytes.tobytes()
                found = [raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]
                columns = [pa.array(found, pa.binary()), pa.array(pairs % classes, pa.int32()), pa.array(count)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "kind", "n"])

    kind = F.col("kind") if "kind" in docs.columns else F.lit(0)
    counted = docs.select("text", kind.cast("int").alias("kind")).mapInArrow(task, "word binary, kind int, n bigint")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    return counted.groupBy("word").agg(*sums)


def _joined(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:]


def estimate(words: DataFrame, path: str = VOCABULARY, rounds: int = 2) -> Pieces:
    """Piece probabilities from distinct words: the prior, then ``rounds`` of expectation maximisation."""
    weights = dict(vocabulary(path))
    names = list(weights)
    keys = piece_keys(names)
    order = np.argsort(keys)
    names, keys = [names[i] for i in order], keys[order]
    prior = np.array([weights[p] for p in names])
    prior *= 1000.0 / prior.sum()
    pieces = Pieces(names, keys, prior)
    spark, n = words.sparkSession, len(names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)

        def task(batches, shared=shared):
            pieces, sums = shared.value, np.zeros(n)
            for batch in batches:
                data, start, end = _joined(batch.column(0))
                for _, matrix in by_length(data, start, end):
                    pieces.expected(matrix, np.ones(len(matrix)), sums)
                for i in np.flatnonzero(end - start > LONG):
                    pieces.expected_one(data[start[i] : end[i]].tobytes(), sums)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["piece", "n"])

        found = words.select("word").mapInArrow(task, "piece bigint, n double")
        found = found.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # at most one row a piece
        sums = prior.copy()
        sums[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        pieces = Pieces(names, keys, sums)
    return pieces


class WordModel:
    """Natural log probabilities of words, by class, from their counts and lattice log probabilities."""

    def __init__(self, tokens: list[int], distinct: list[int], once: int, twice: int):
        self.tokens, self.distinct = tokens, distinct
        self.discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5

    def log_p(self, c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """words x classes, from counts of that shape."""
        return np.stack([self.log_p_of(k, c[:, k], lattice) for k in range(len(self.tokens))], axis=1)

    def log_p_of(self, k: int, c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """Of class ``k`` alone."""
        if not self.tokens[k]:
            return lattice
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(c - self.discount, 0.0))
        return np.logaddexp(own, lattice + np.log(self.discount * self.distinct[k])) - np.log(self.tokens[k])


def scores(
    docs: DataFrame, learn: Column, kind: str | None = None, path: str = VOCABULARY, rounds: int = 2
) -> DataFrame:
    """Per document: doc_id, held_out (not ``learn``), n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text, end included. ``kind`` names the column of the
    classes; it is read in training rows only, and at most ``MAX_KINDS`` values are model parameters.
    """
    spark = bounded_batches(docs).sparkSession
    value = F.coalesce(F.col(kind).cast("string"), F.lit("")) if kind else F.lit("")
    kinds, ends_k = _classes(docs.where(learn).groupBy(value.alias("kind")).agg(F.count("*").alias("n")))
    number = F.array_position(F.array(*[F.lit(k) for k in kinds]), value)
    number = F.when(number > 0, number - 1).otherwise(len(ends_k) - 1)
    docs = docs.select("doc_id", "text", F.when(learn, number).otherwise(-1).cast("int").alias("kind"))
    words = materialize(count_words(docs.where("kind >= 0"), len(ends_k)), "words")
    counts = [F.col(f"c{k}") for k in range(len(ends_k))]
    total = sum(counts[1:], counts[0])
    size = one(
        words.agg(
            F.count("*").alias("v"), F.count_if(total == 1).alias("once"), F.count_if(total == 2).alias("twice"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n{k}") for k, c in enumerate(counts)],
            *[F.count_if(c > 0).alias(f"v{k}") for k, c in enumerate(counts)],
        )
    )
    tokens_k, ends = [size[f"n{k}"] for k in range(len(ends_k))], sum(ends_k)
    tokens, distinct = sum(tokens_k) + ends, size["v"] + (1 if ends else 0)
    pieces = estimate(words, path, rounds)
    model = WordModel(tokens_k, [size[f"v{k}"] for k in range(len(ends_k))], size["once"], size["twice"])
    # at most HEAD words can have more than 1 / HEAD of all tokens
    head = words.where(total > max(tokens // HEAD, 1)).toArrow()
    hashes = _hash_column(head.column("word"))
    order = np.argsort(hashes)
    table = np.stack([head.column(f"c{k}").to_numpy() for k in range(len(ends_k))], axis=1)[order]
    shared = spark.sparkContext.broadcast((pieces, model, hashes[order], table))
    blocks = power_of_two(tokens / 3 / BLOCK, 8)

    parts = min(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), MAX_PARTS)
    sent = docs.mapInArrow(_reader(shared, blocks.bit_length() - 1), f"block bigint, {_PACKET}, {_WORDS}")
    met = sent.repartition(parts, "block").groupBy("block").applyInArrow(_meet(len(ends_k)), f"block bigint, {_PACKET}, answer binary")
    out = met.repartition(parts, "packet").groupBy("packet").applyInArrow(_add(model), _SUMS)
    floor = float(np.log10(tokens + distinct + 1.0))
    known = F.col("known") + (1 if ends else 0)
    base = F.col("base") + float(np.log10(ends + 1.0)) - F.col("n_tokens") * floor
    # for each class: its share of the documents, its words, its end
    by_class = []
    for k, (n, e) in enumerate(zip(tokens_k, ends_k)):
        end = (e + 1.0) / (n + e + 2.0)
        fixed = float(np.log((e + 0.5) / (ends + 0.5 * len(ends_k))) + np.log(end))
        by_class.append(F.get("score", F.lit(k)) + (F.col("n_tokens") - 1) * float(np.log1p(-end)) + fixed)
    out = out.withColumn("paths", F.array(*by_class)).withColumn("top", F.array_max("paths"))
    rest = F.aggregate("paths", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return out.select(
        "doc_id",
        (F.col("kind") < 0).alias("held_out"),
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        ((F.col("top") + F.log(rest)) / float(np.log(10.0))).alias("score"),
    )


def _classes(found: DataFrame) -> tuple[list[str], list[int]]:
    """Names of the classes with counts of their own, and the training rows of each class.

    There is one more number than names if there are further classes, which share the last one.
    """
    size = one(found.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")))
    own = MAX_KINDS if size["kinds"] <= MAX_KINDS else MAX_KINDS - 1
    largest = found.orderBy(F.desc("n"), "kind").limit(own).collect()
    rows = {r["kind"]: r["n"] for r in sorted(largest, key=lambda r: r["kind"])}
    names, ends = list(rows) or [""], list(rows.values()) or [0]
    return names, ends if size["kinds"] <= own else [*ends, size["rows"] - sum(ends)]


def _hash_column(column) -> np.ndarray:
    """The hashes that ``Words`` gives to these words."""
    raw = column.to_pylist()
    text = b" ".join(raw)
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return words.hashes()


#: One row a packet: its documents, packed by column, and its pairs in the order of the words' hashes.
_PACKET = (
    "packet bigint, doc_id array<bigint>, kind binary, n_tokens binary, known binary, base binary, score binary, "
    "degree binary, owner binary, uses binary, lattice binary"
)
#: One row for a packet and a block: the packet's words in it, each with its uses in every class it has there.
_WORDS = "hashes binary, kinds binary, counts binary"
_SUMS = "doc_id bigint, kind int, n_tokens bigint, known bigint, base double, score array<double>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, lowest bytes first, which compress well if most numbers are small."""
    return packed(np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T)


def _from_planes(value: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _reader(shared, bits: int):
    """Packets (block -1 - packet) with what the task knows of their documents, and their rarer words by block."""
    columns = ["block", *_names(_PACKET), *_names(_WORDS)]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * (len(columns) - 3)

    def rows(n: int, **given):
        arrays = [pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    # a word is told apart by the upper bits of its hash, which name the block, and six bytes
    told = np.uint64(((1 << bits) - 1 << 64 - bits | (1 << 48) - 1) & (1 << 64) - 1)

    def send(packet: int, docs: list[tuple], pairs: list[tuple]):
        ids, *told_of = zip(*docs)
        kind, n_tokens, known, base, score = (np.concatenate(x) for x in told_of)
        h, owner, count, lattice = (np.concatenate(x) for x in zip(*pairs))
        h &= told
        order = np.argsort(h, kind="stable")
        h, owner, count = h[order], owner[order], count[order]
        starts = runs_of(h)
        yield rows(
            1, block=[-1 - packet], packet=[packet], doc_id=[[i for part in ids for i in part]], kind=[packed(kind.astype(np.int32))],
            n_tokens=[packed(n_tokens)], known=[packed(known)], base=[packed(base)], score=[packed(score)],
            degree=[_planes(np.diff(starts))], owner=[_planes(owner)], uses=[_planes(count)],
            lattice=[packed(lattice[order][starts[:-1]].astype(np.float32))],
        )
        if not len(h):
            return
        # uses by (word, class)
        classes = kind[owner]
        order = np.lexsort((classes, h))
        h, classes, count = h[order], classes[order], count[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (classes[1:] != classes[:-1])
        at = np.flatnonzero(new)
        h, classes, count = h[at], classes[at].astype(np.int8), np.add.reduceat(count, at)
        low = h.view(np.uint8).reshape(-1, 8)[:, :6]
        block = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        cuts = runs_of(block)
        parts = list(zip(cuts[:-1], cuts[1:]))
        yield rows(
            len(parts), block=block[cuts[:-1]], packet=np.full(len(parts), packet), hashes=[packed(low[x:y]) for x, y in parts],
            kinds=[packed(classes[x:y]) for x, y in parts], counts=[_planes(count[x:y]) for x, y in parts],
        )

    def task(batches):
        pieces, model, head, head_c = shared.value
        packet = TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        pairs: list[tuple] = []
        n_docs = n_pairs = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            kinds = batch.column(2).to_numpy()
            for a, b in slices(offsets, 4 << 20):
                n = b - a
                words = Words(data, offsets[a : b + 1])
                h, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
                log_p = log_probabilities(pieces, words.bytes, words.start[first], words.end[first])
                doc = np.repeat(np.arange(n), np.diff(words.at))
                place = np.minimum(np.searchsorted(head, h), max(len(head) - 1, 0))
                common = head[place] == h if len(head) else np.zeros(len(h), bool)
                c = np.zeros((len(h), head_c.shape[1]))
                c[common] = head_c[place[common]]
                base = np.log10(c.sum(axis=1) + 1.0)
                own = np.zeros_like(c)
                own[common] = model.log_p(c[common], log_p[common])
                score = np.stack([np.bincount(doc, own[inverse, k], n) for k in range(c.shape[1])], axis=1)
                known = np.bincount(doc[common[inverse]], minlength=n)
                docs.append(
                    (batch.column(0).slice(a, n).to_pylist(), kinds[a:b], np.diff(words.at) + 1, known, np.bincount(doc, base[inverse], n), score)
                )
                rare = ~common[inverse]
                found, count = np.unique(doc[rare] * len(h) + inverse[rare], return_counts=True)
                owner, word = (found // len(h), found % len(h)) if len(found) else (found, found)
                pairs.append((h[word] if len(found) else h[:0], owner + n_docs, count, log_p[word] if len(found) else log_p[:0]))
                n_docs, n_pairs = n_docs + n, n_pairs + len(found)
                if n_pairs >= BLOCK or n_docs >= PACKET_DOCS:
                    yield from send(packet, docs, pairs)
                    packet, docs, pairs, n_docs, n_pairs = packet + 1, [], [], 0, 0
        if docs:
            yield from send(packet, docs, pairs)

    return task


def _meet(classes: int):
    """One block of words: counts over the training rows of all packets, sent back to each packet. A packet's own row passes."""
    columns = _names(_PACKET)

    def task(table: pa.Table) -> pa.Table:
        blocks = table.column("block")
        if blocks[0].as_py() < 0:
            return table.select(["block", *columns]).append_column("answer", pa.nulls(len(table), pa.binary()))
        lengths = [len(k) for k in table.column("kinds").to_pylist()]
        kind = unpacked(table.column("kinds"), np.int8)
        count = np.concatenate([_from_planes(v) for v in table.column("counts").to_pylist()])
        h = np.zeros((len(kind), 8), np.uint8)
        h[:, :6] = unpacked(table.column("hashes"), np.uint8).reshape(-1, 6)
        h = h.view(np.uint64).ravel()
        ids, word = np.unique(h, return_inverse=True)
        c = np.stack([np.bincount(word[kind == k], count[kind == k], len(ids)) for k in range(classes)]).astype(np.uint32)
        answers = []
        for b, n in zip(np.cumsum(lengths), lengths):
            asked = word[b - n : b]
            asked = asked[runs_of(asked)[:-1]]  # a word of several classes is asked for once
            answers.append(_planes(c[:, asked].ravel()))
        given = {"block": blocks, "packet": table.column("packet"), "answer": pa.array(answers, pa.binary())}
        names = ["block", *columns, "answer"]
        return pa.table([given.get(n, table.column(n) if n in table.column_names else None) for n in names], names=names)

    return task


def _lists(values: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _add(model: WordModel):
    """The documents of a packet with the sums over all their words."""
    classes = len(model.tokens)

    def task(table: pa.Table) -> pa.Table:
        own, answers = None, []
        for block, row in zip(table.column("block").to_pylist(), range(len(table))):
            if block < 0:
                own = {c: table.column(c)[row].as_py() for c in _names(_PACKET)}
            else:
                answers.append((block, _from_planes(table.column("answer")[row].as_py()).reshape(classes, -1)))
        c = [x for _, x in sorted(answers, key=lambda x: x[0])]
        c = np.concatenate(c, axis=1) if c else np.zeros((classes, 0), np.uint32)
        column = lambda name, kind: np.frombuffer(own[name], kind)
        degree, owner, uses = (_from_planes(own[x]).astype(np.int64) for x in ("degree", "owner", "uses"))
        lattice = column("lattice", np.float32).astype(np.float64)
        n = len(own["doc_id"])
        score = column("score", np.float64).reshape(n, classes).copy()
        all_c = c.sum(axis=0, dtype=np.int64)
        known = np.bincount(owner, np.repeat(all_c > 0, degree) * uses, n).astype(np.int64)
        base = np.bincount(owner, np.repeat(np.log10(all_c + 1.0), degree) * uses, n)
        for k in range(classes):
            score[:, k] += np.bincount(owner, np.repeat(model.log_p_of(k, c[k].astype(np.float64), lattice), degree) * uses, n)
        return pa.table(
            {
                "doc_id": pa.array(own["doc_id"], pa.int64()),
                "kind": column("kind", np.int32),
                "n_tokens": column("n_tokens", np.int64),
                "known": column("known", np.int64) + known,
                "base": column("base", np.float64) + base,
                "score": _lists(score),
            }
        )

    return task
