"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (equal sets, so all exact copies, share one row),
columns are word n-grams. With threshold t, linked sets x and y overlap in at least t * |x| columns.

1. ``sets``: one pass hashes the texts: (doc_id, node, n_shingles), node being a 64-bit digest of the
   whole set.
2. The cells are sent to blocks of columns (packed arrays, one row per task and block). A block
   multiplies its columns: those met once are only counted, for the others it returns
   (node, column, column size).
3. A row with more unmatched columns than |x| - t|x| can reach no partner and is discarded. The
   others keep their rarest |x| - t|x| + 1 columns, of which the matched ones are of use: by the
   prefix argument two linked rows share one.
4. Overlaps are accumulated for pairs of rows that share a kept column and pass the bound
   min(|x| - r(x), |y| - r(y)) >= t * max(|x| + r(y), |y| + r(x)), r being how many columns of the row are
   rarer than the shared one: were it the first they share, those would limit the overlap and widen
   the union; and two linked rows pass the bound at the first column they share. First each row is compared with the most central row of
   each column; after that only pairs that are not yet in one component are. So near copies of one
   text cost about one pair each, and no link between different components is lost.
5. Overlaps of these pairs are counted over the whole sets.
6. The number of links of each document, where it is wanted, takes all pairs inside a component (no link
   leaves one): its rows are dealt into chunks, and each pair of chunks is multiplied in a task of its own.

Exact up to collisions of 64-bit hashes. Corpus-wide data stays in Spark; block sizes are constant
as the data grows. Intermediate tables are written to the shared folder.

Cases: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer
than n words has one shingle; equal doc_ids or rows and null ids are kept as rows (a component is
named by its least id that is not null).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstrata.llm.common import (
    Words,
    bounded_batches,
    components,
    mix,
    one,
    packed,
    power_of_two,
    runs_of,
    shingle_hashes,
    slices,
    text_buffer,
    unpacked,
)
from tabstrata.runtime import materialize

#: Cells per block, and rows per group of rows: a few dozen MB in a task.
BLOCK, GROUP = 1 << 20, 1 << 13
#: Rows and cells per chunk of a component whose links are counted.
CHUNK, CHUNK_CELLS = 128, 1 << 19
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column, n: int):
    """(row, sorted distinct shingle hashes) of each text of an Arrow column."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        words = Words(data, offsets[a : b + 1])
        hashes, at = shingle_hashes(words.hashes(), words.at, n)
        for i in range(b - a):
            part = np.sort(hashes[at[i] : at[i + 1]])
            if len(part) > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            yield a + i, part


def node_of(part: np.ndarray) -> int:
    """Digest of a set; a null node stands for the empty set."""
    return int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets(docs: DataFrame, n: int) -> DataFrame:
    def task(batches):
        for batch in batches:
            nodes, sizes = [], []
            for _, part in shingle_sets(batch.column(1), n):
                nodes.append(node_of(part) if len(part) else None)
                sizes.append(len(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())],
                names=["doc_id", "node", "n_shingles"],
            )

    docs = bounded_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, node bigint, n_shingles bigint")


def prefix_length(size, percent: int):
    """|x| - ceil(t|x|) + 1."""
    return size + (-percent * size) // 100 + 1


def _packets(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """The cells of each distinct set, packed by block of columns: 32 bits of the column's hash beside
    those of the block, and the node. Should two columns of a block coincide, they count as one,
    which only makes the bounds weaker."""

    def task(batches):
        seen: set[int] = set()
        kept: list[tuple[np.ndarray, int]] = []
        total = 0

        def flush():
            counts = [len(h) for h, _ in kept]
            spread = mix(np.concatenate([h for h, _ in kept]) ^ _SALT)
            node = np.repeat(np.array([k[1] for k in kept], np.int64), counts)
            block = (spread >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            cuts = runs_of(block[order])
            rows = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
            low = spread.astype(np.uint32)
            binary = lambda values: pa.array([packed(values[r]) for r in rows], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([block[r[0]] for r in rows], pa.int32()), binary(low), binary(node)],
                names=["block", "low", "node"],
            )

        for batch in batches:
            for _, part in shingle_sets(batch.column(0), n):
                if not len(part) or (node := node_of(part)) in seen:
                    continue
                seen.add(node)
                kept.append((part, node))
                total += len(part)
                if total >= BLOCK:
                    yield flush()
                    kept, total = [], 0
        if total:
            yield flush()

    return docs.select("text").mapInArrow(task, "block int, low binary, node binary")


def _multiply(groups: int):
    """One block of columns: unmatched columns are counted by row, matched ones returned."""

    def task(table: pa.Table) -> pa.Table:
        block = np.uint64(table.column("block")[0].as_py())
        h, node = unpacked(table.column("low"), np.uint32), unpacked(table.column("node"), np.int64)
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        starts = np.concatenate([[True], h[1:] != h[:-1]])
        keep = starts | np.concatenate([[True], node[1:] != node[:-1]])  # a set sent by two tasks counts once
        h, node = h[keep], node[keep]
        length = np.diff(np.concatenate([np.flatnonzero(starts[keep]), [len(h)]]))
        df = np.repeat(length, length).astype(np.uint32)
        column = (block << np.uint64(32)) | h
        group = node.view(np.uint64) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        cuts = runs_of(group[order])
        rows = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
        single = [np.unique(node[r[df[r] == 1]], return_counts=True) for r in rows]
        shared = [r[df[r] > 1] for r in rows]
        binary = lambda arrays: pa.array([packed(x) for x in arrays], pa.binary())
        return pa.table(
            {
                "g": pa.array([int(group[r[0]]) for r in rows], pa.int64()),
                "lone_node": binary(s[0] for s in single),
                "lone_count": binary(s[1].astype(np.uint32) for s in single),
                "node": binary(node[r] for r in shared),
                "col": binary(column[r] for r in shared),
                "df": binary(df[r] for r in shared),
            }
        )

    return task


_MULTIPLIED = "g bigint, lone_node binary, lone_count binary, node binary, col binary, df binary"
_KEPT = "col bigint, node bigint, n bigint, r bigint, u bigint, spread double"


def _prefixes(percent: int):
    """The kept columns of the rows of one group, for rows that can have partners."""

    def task(table: pa.Table) -> pa.Table:
        node = unpacked(table.column("node"), np.int64)
        col, df = unpacked(table.column("col"), np.uint64), unpacked(table.column("df"), np.uint32)
        lone, count = unpacked(table.column("lone_node"), np.int64), unpacked(table.column("lone_count"), np.uint32)
        ids, at = np.unique(node, return_inverse=True)
        where = np.minimum(np.searchsorted(ids, lone), max(len(ids) - 1, 0))
        known = ids[where] == lone if len(ids) else np.zeros(len(lone), bool)
        unmatched = np.bincount(where[known], count[known], len(ids)).astype(np.int64)
        order = np.lexsort((col, df, at))
        cuts = runs_of(at[order])
        rank = np.arange(len(order)) - np.repeat(cuts[:-1], np.diff(cuts))
        row = at[order]
        matched = np.bincount(at, minlength=len(ids))
        size = matched + unmatched
        use = rank < prefix_length(size[row], percent) - unmatched[row]
        r, row = order[use], row[use]
        spread = np.bincount(at, df, len(ids)) / np.maximum(matched, 1)
        return pa.table(
            {
                "col": col[r].view(np.int64),
                "node": node[r],
                "n": size[row],
                "r": unmatched[row] + rank[use],
                "u": unmatched[row],
                "spread": spread[row],
            }
        )

    return task


def verified(pairs: DataFrame, incidence: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = incidence.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = incidence.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def task(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                overlap = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * overlap >= percent * (len(x) + len(y) - overlap)
            yield batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(task, "a bigint, b bigint")


def _incidence(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, hashes) of the wanted (doc_id, node): whole sets, read from the texts again."""

    def task(batches):
        for batch in batches:
            nodes, parts = batch.column(1).to_pylist(), []
            for i, part in shingle_sets(batch.column(0), n):
                if len(part) and node_of(part) == nodes[i]:
                    parts.append((nodes[i], part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary())],
                names=["node", "hashes"],
            )

    wanted = wanted.select(F.col("doc_id").alias("wanted_id"), "node")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    found = texts.select("text", "node").mapInArrow(task, "node bigint, hashes binary")
    return found.groupBy("node").agg(F.first("hashes").alias("hashes"))


def _within(percent: int):
    """The bound on rows of n and m cells that have r and q cells before their first shared column."""
    return F.expr(f"100 * least(n - r, m - q) >= {percent} * greatest(n + q, m + r)")


def _named(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, node, n_shingles); nodes with their least doc_id, copies and component; whole sets of linked nodes."""
    keyed = materialize(sets(docs, n), "sets")
    nodes = keyed.where("node is not null").groupBy("node", "n_shingles")
    nodes = materialize(nodes.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "nodes")
    edges, incidence = _links(docs, nodes, n, percent)
    edges = materialize(edges, "links")
    reached = components(edges)
    named = nodes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return keyed, named, incidence


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, node and, with ``links``, n_links.

    Two documents link when 100 * overlap >= percent * union of their n-gram sets; component_id is
    the least doc_id reachable by links. ``node`` names the set of a document (null: empty). n_links
    is the number of other rows that a document links with, copies among them.
    """
    keyed, named, incidence = _named(docs, n, percent)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    if links:
        named = materialize(named, "named")
        counts = link_counts(named, incidence, percent)
        named = named.join(counts, "node", "left")
        named = named.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    more = ["n_links"] if links else []
    named = named.join(least, "component").select("node", "component_id", *more)
    # a node of many copies is a hot key: its side is one row, so adaptive execution can split it
    out = keyed.join(named, "node", "left")
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", *more)


def _counted(percent: int):
    """Links by row between two chunks of a component, or inside one."""

    def task(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        chunk = table.column("chunk").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        cells = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("hashes").chunks for x in c]
        size = np.array([len(c) for c in cells])
        left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        found = np.zeros(len(cells), np.int64)
        if len(left) and len(right):
            h = np.concatenate([cells[i] for i in right])
            owner = np.repeat(np.arange(len(right)), size[right])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            for i in left:
                first = np.searchsorted(h, cells[i], "left")
                count = np.searchsorted(h, cells[i], "right") - first
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(right))
                linked = (100 * both >= percent * (size[i] + size[right] - both)) & (right != i)
                found[i] += copies[right][linked].sum()
                if lo != hi:  # inside a chunk each row has its own turn
                    found[right[linked]] += copies[i]
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(found, pa.int64())})

    return task


def link_counts(named: DataFrame, incidence: DataFrame, percent: int) -> DataFrame:
    """(node, links): rows of other nodes that a node links with, for nodes of components of several."""
    parts = named.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("cells"))
    parts = parts.where("rows > 1").select(
        "component", F.ceil(F.greatest(F.col("rows") / CHUNK, F.col("cells") / CHUNK_CELLS)).cast("int").alias("chunks")
    )
    rows = named.select("node", "component", "copies").join(parts, "component").join(incidence, "node")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        "component", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "copies", "hashes"
    )
    found = rows.groupBy("component", "lo", "hi").applyInArrow(_counted(percent), "node bigint, links bigint")
    return materialize(found.groupBy("node").agg(F.sum("links").alias("links")), "counts")


def _links(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Enough verified links (a, b) between nodes to connect what all links connect, and the sets compared."""
    sizes = one(nodes.agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("cells")))
    blocks = power_of_two((sizes["cells"] or 0) / BLOCK, 8)
    groups = power_of_two(sizes["rows"] / GROUP, 8)
    packets = _packets(docs, n, blocks.bit_length() - 1)
    shared = packets.groupBy("block").applyInArrow(_multiply(groups), _MULTIPLIED)
    kept = shared.groupBy("g").applyInArrow(_prefixes(percent), _KEPT)
    kept = materialize(kept, "columns")

    # the most central row of a column: fewest unmatched columns, then the most shared others
    centre = kept.groupBy("col").agg(
        F.min(F.struct("u", (-F.col("spread")).alias("s"), "node", "n", "r")).alias("c"), F.count("*").alias("rows")
    )
    centre = centre.where("rows > 1").select(
        "col", F.col("c.node").alias("other"), F.col("c.n").alias("m"), F.col("c.r").alias("q")
    )
    first = kept.join(centre, "col").where("node != other").where(_within(percent))
    first = materialize(first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    incidence = materialize(_incidence(docs, _wanted(first, nodes), n), "incidence")
    links = materialize(verified(first, incidence, percent), "links")

    # what the first comparisons have not connected
    reached = components(links)
    placed = kept.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a column's largest component is compared with the others only, never with itself
    parts = placed.groupBy("col", "component").agg(F.count("*").alias("rows"))
    major = parts.groupBy("col").agg(F.max(F.struct("rows", "component")).alias("x"), F.count("*").alias("parts"))
    major = major.where("parts > 1").select("col", F.col("x.component").alias("major"))
    placed = placed.join(major, "col")
    other = placed.select(
        "col", F.col("node").alias("b"), F.col("n").alias("m"), F.col("r").alias("q"), F.col("component").alias("other")
    )
    minor = placed.where("component != major").withColumnRenamed("node", "a")
    second = minor.join(other, "col").where("component != other and (a < b or other = major)")
    second = second.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    second = second.where(_within(percent)).select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    second = materialize(second, "pairs")
    have = incidence.select("node")
    missing = _wanted(second, nodes).join(have, "node", "left_anti")
    more = materialize(_incidence(docs, missing, n), "incidence")
    incidence = incidence.unionByName(more)
    return links.unionByName(verified(second, incidence, percent)), incidence


def _wanted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return nodes.join(ends, "node").select("doc_id", "node")


def with_node(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` plus the column ``__node``: the digest of each text's set, null where it is empty."""

    def task(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            nodes = [node_of(part) if len(part) else None for _, part in shingle_sets(column, n)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "__node"]
            )

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType())]))


def deduplicated(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id; same columns.

    Rows without shingles are no duplicates of anything and stay. A component without ids keeps a row, too.
    Where several rows of a component have its least id, one of them stays.
    """
    _, named, _ = _named(docs, n, percent)
    # components are told apart by their node: ids may be null, or stand on different texts
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("x")
    best = named.groupBy("component").agg(first).select(F.col("x.doc_id").alias("__id"), F.col("x.node").alias("__best"))
    best = materialize(best, "kept")
    marked = with_node(docs, n)
    own = marked["doc_id"].eqNullSafe(best["__id"]) & (marked["__node"] == best["__best"])
    kept = marked.join(best, own).drop("__id", "__best").dropDuplicates(["doc_id", "__node"])
    return kept.unionByName(marked.where("__node is null")).select(*docs.columns)
