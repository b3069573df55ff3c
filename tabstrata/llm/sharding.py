"""Sharding by minimax contiguous partition, in DataFrame functions only.

Documents of equal text are one group and stay together. Groups stand in the order of the md5 of
their text, which mixes sources over the shards; their running bytes are the possible cuts. The
least capacity with which a greedy walk fills at most the given number of shards is found by binary
search. Under that capacity the order is then cut evenly: a group larger than an even share has a shard
of its own, the stretches between such groups share the other shards by their bytes, every shard gets a
group while there are enough, and each cut is the one nearest to an even share that leaves the rest feasible.

Scale: texts are read once and never shuffled; all else works on (id, md5, size, crc) rows on the
shared folder. Running sums take one window for each of 4096 md5 ranges plus their offsets. The
driver never holds the groups: it asks Spark for the largest cut in each of a bounded number of
bins, searches with what is known, and asks again, finer, only for bins whose inner cuts could
change an answer. Rows of one hot text are spread over salted cells when slots are numbered.

Cases: null texts count as empty ones, of size 8 a row and crc 0; an empty table gives no rows; with
fewer groups than shards the last shards stay empty; repeated rows get a slot each.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabstrata.llm.common import one
from tabstrata.runtime import materialize, small_rows

#: Bytes that a document costs beside its text.
OVERHEAD = 8
#: Bins of the first look at the cuts, and of every bin that is looked at again.
BINS, FINER = 4096, 64
SALTS = 64
#: A cut nearest to an even share is sought to this part of the share.
NEAR = 100


def keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.md5(raw).alias("key"),
    )


def _range(key: Column) -> Column:
    """One of 4096 ranges of md5 keys, in their order."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def running(groups: DataFrame) -> DataFrame:
    """(key, bytes) in key order plus ``upto``, the bytes of all groups to this one."""
    groups = groups.withColumn("range", _range(F.col("key")))
    inside = F.sum("bytes").over(W.partitionBy("range").orderBy("key"))
    sums = groups.groupBy("range").agg(F.sum("bytes").alias("n"))
    before = sums.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    return groups.withColumn("upto", inside).join(before, "range").withColumn("upto", F.col("upto") + F.col("before"))


class Cuts:
    """What is known of the sorted cuts: some of them, and the gaps between that may hide others."""

    def __init__(self, table: DataFrame, total: int):
        self.table, self.total = table, total
        self.known: list[int] = [0]
        self.hidden: dict[int, int] = {}  # cut -> how far the gap above it may hide more
        self._ask([(0, total)], BINS)

    def _ask(self, gaps: list[tuple[int, int]], bins: int) -> None:
        """Looks into gaps (a, b]: keeps the largest cut of every bin."""
        width = max(-(-(b - a) // bins) for a, b in gaps)
        if len(gaps) == 1:
            low = F.lit(gaps[0][0])
            inside = (F.col("upto") > gaps[0][0]) & (F.col("upto") <= gaps[0][1])
        else:  # gaps are disjoint: find a row's gap among their starts
            coarse = max(-(-self.total // BINS), 1)
            cells = sorted({c for a, b in gaps for c in range(a // coarse, b // coarse + 1)})
            near = F.expr(f"upto div {coarse}").isin(cells)
            starts = F.split(F.lit(",".join(str(a) for a, _ in gaps)), ",").cast("array<bigint>")
            ends = F.split(F.lit(",".join(str(b) for _, b in gaps)), ",").cast("array<bigint>")
            at = F.size(F.filter(starts, lambda s: s < F.col("upto"))) - 1
            low = F.get(starts, at)
            inside = near & (at >= 0) & (F.col("upto") <= F.get(ends, at))
        rows = self.table.where(inside).select("upto", low.alias("low"))
        rows = rows.groupBy("low", F.expr(f"(upto - low - 1) div {width}").alias("bin"))
        rows = rows.agg(F.max("upto").alias("top"), F.count("*").alias("n"))
        for row in small_rows(rows, len(gaps) * bins + len(gaps), "bins of cuts"):
            if row["n"] > 1:
                self.hidden[row["top"]] = row["low"] + row["bin"] * width
            self.known.append(row["top"])
        self.known.sort()

    def below(self, x: int) -> tuple[int, int]:
        """The largest known cut up to x, and the most that a hidden cut up to x can be."""
        i = bisect_right(self.known, x) - 1
        low = self.known[i]
        if i + 1 < len(self.known):
            above = self.known[i + 1]
            if above in self.hidden and self.hidden[above] < x:
                return low, x
        return low, low

    def walk(self, capacity: int, shards: int, hopeful: bool) -> tuple[list[int], set[int]]:
        """Greedy cuts at a capacity, and the known cuts whose bins hide what would be exact."""
        out, at, unsure = [], 0, set()
        for _ in range(shards):
            low, high = self.below(at + capacity)
            if low != high:
                unsure.add(self.known[bisect_right(self.known, at + capacity)])
            at = high if hopeful else low
            out.append(at)
            if at >= self.total:
                break
        return out, unsure

    def learn(self, cut: int) -> None:
        """Makes a cut known."""
        i = bisect_left(self.known, cut)
        above = self.known[i]
        if above == cut:
            return
        low = self.hidden.get(above)
        if low is not None and low < cut - 1:
            self.hidden[cut] = low
        if low is not None:
            if cut < above - 1:
                self.hidden[above] = cut
            else:
                del self.hidden[above]
        self.known.insert(i, cut)

    def refine(self, tops: set[int]) -> None:
        gaps = []
        for top in sorted(tops):
            gaps.append((self.hidden.pop(top), top - 1))
        self._ask(gaps, FINER)


def minimax(cuts: Cuts, largest: int, shards: int) -> tuple[int, list[int]]:
    """The least capacity that suffices, and the ends of the shards of the walk at it."""
    total = cuts.total
    while True:
        low, high = max(largest, -(-total // shards)), total
        unsure: set[int] = set()
        while low < high:
            mid = (low + high) // 2
            sure, doubts = cuts.walk(mid, shards, hopeful=False)
            if sure[-1] >= total:
                high = mid
                continue
            hope, more = cuts.walk(mid, shards, hopeful=True)
            if hope[-1] < total:
                low = mid + 1
                continue
            unsure |= doubts | more
            high = mid  # explores both ends of what is not yet decided
        ends, doubts = cuts.walk(low, shards, hopeful=False)
        unsure |= doubts
        if not unsure:
            return low, ends
        cuts.refine(unsure)


def _hot(large: list[tuple[int, int]], total: int, shards: int) -> list[tuple[int, int]]:
    """(start, end) of the groups larger than an even share of what the larger ones leave."""
    out, rest = [], total
    for size, upto in sorted(large, key=lambda g: (-g[0], g[1])):
        if size * (shards - len(out)) <= rest or len(out) == shards - 1:
            break
        out.append((upto - size, upto))
        rest -= size
    return sorted(out)


def even(cuts: Cuts, capacity: int, shards: int, hot: list[tuple[int, int]], tail: list[int]) -> list[int]:
    """Ends of even shards of at most ``capacity`` bytes, none of them empty.

    ``tail`` has the last ends of groups, the last one first. Groups are more than shards.
    """
    total = cuts.total
    for cut in [*tail, *(x for h in hot for x in h if x)]:
        cuts.learn(cut)
    while True:
        # from which end of each shard on the shards after it can hold the rest
        least = [total]
        for _ in range(shards):
            least.append(cuts.known[bisect_left(cuts.known, max(least[-1] - capacity, 0))])
        at, out, unsure = 0, [], set()
        for k in range(1, shards + 1):
            low, high = max(least[shards - k], at + 1), min(at + capacity, tail[shards - k])
            aim = at + _share(at, total, shards - k + 1, [h for h in hot if h[0] >= at])
            a, b = bisect_left(cuts.known, low), bisect_right(cuts.known, high)
            if a == b:  # the next cut is hidden
                unsure.add(cuts.known[a])
                break
            i = bisect_left(cuts.known, aim)
            if i < len(cuts.known) and (top := cuts.known[i]) in cuts.hidden:
                if (top - max(cuts.hidden[top], at)) * NEAR > aim - at:
                    unsure.add(top)
            at = min(cuts.known[max(a, min(i - 1, b - 1)) : max(a, min(i, b - 1)) + 1], key=lambda e: abs(e - aim))
            out.append(at)
        if not unsure:
            return out
        cuts.refine(unsure)


def _share(at: int, total: int, shards: int, hot: list[tuple[int, int]]) -> int:
    """Bytes of the next of the shards that are left."""
    if hot and hot[0][0] == at:
        return hot[0][1] - at
    rest, free = total - at - sum(b - a for a, b in hot), max(shards - len(hot), 1)
    stretch = (hot[0][0] if hot else total) - at
    parts = min((2 * free * stretch + rest) // (2 * rest), free)
    if not parts:  # too few for a shard: together with the group after it
        return hot[0][1] - at
    return -(-stretch // parts)


def shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    rows = materialize(keyed(docs), "keyed")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = materialize(running(groups).select("key", "bytes", "upto"), "groups")
    facts = one(groups.agg(F.max("upto").alias("total"), F.max("bytes").alias("largest")))
    ends = [0]
    if facts["total"]:
        cuts = Cuts(groups, facts["total"])
        capacity, ends = minimax(cuts, facts["largest"], n_shards)
        tail = [r["upto"] for r in groups.select("upto").orderBy(F.desc("upto")).limit(n_shards + 1).collect()]
        if len(tail) <= n_shards:
            ends = tail[::-1]
        else:
            large = groups.select("bytes", "upto").orderBy(F.desc("bytes"), "upto").limit(n_shards).collect()
            ends = even(cuts, capacity, n_shards, _hot([tuple(r) for r in large], facts["total"], n_shards), tail[:n_shards])
    # a group's shard: how many shards end before it
    limits = F.array(*[F.lit(e).cast("long") for e in ends])
    placed = groups.select("key", F.size(F.filter(limits, lambda e: e < F.col("upto"))).alias("shard"))
    rows = rows.join(placed, "key")
    cell = ["shard", "range", "salt"]
    rows = rows.withColumn("range", _range(F.col("key"))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    rows = materialize(rows, "placed")
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    before = sizes.select(*cell, (F.sum("n").over(W.partitionBy("shard").orderBy("range", "salt")) - F.col("n")).alias("before"))
    at = F.row_number().over(W.partitionBy(*cell).orderBy("key", "doc_id")) - 1
    rows = rows.withColumn("at", at).join(before, cell)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") + F.col("before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
