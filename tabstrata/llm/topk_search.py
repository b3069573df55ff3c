"""Exact top-k search in binary codes by incremental multi-index hashing.

A code is cut into segments of up to 16 bits; the index holds every distinct code once per segment.
For a query all buckets whose segment differs in at most r bits are probed, r = 0, 1, 2, ... Once
all segments have been searched to radius r, every code at distance below segments * (r + 1) has
been met; a query stops growing when its k-th verified distance is below that bound. Until then its
k-th distance so far bounds the candidates of the next radius.

A query id that stands on several codes is searched for itself, its own rows being left out of what its search meets, so that
they never take the place of a neighbour; all other queries of one code are one search.

Scale: queries and index meet in joins on (segment, value); neither is broadcast. Equal codes are
one row that keeps its k + 1 least ids, so a group of copies costs one candidate; adaptive execution
can split a full bucket. Each radius is one join for the queries still open; their best k so far
are written to the shared folder, so a lost executor repeats one radius only.

Cases: a null vector has no code: it is not found, and as query finds nothing; null or NaN elements
give bit 0 and 1; rows of equal ids are one
id on several codes, never its own neighbour, and a neighbour once for each code; ties are taken by least id; fewer than k
rows return all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabstrata.runtime import materialize

SEGMENT = 16


def sign_code(vector: Column, bits: int) -> Column:
    """Array of segments: bit i of the code is set where element i is not negative."""
    segments = []
    for at in range(0, bits, SEGMENT):
        word = F.lit(0)
        for i in range(at, min(at + SEGMENT, bits)):
            word = word + F.when(F.get(vector, F.lit(i)) >= 0, 1 << (i - at)).otherwise(0)
        segments.append(word)
    return F.when(vector.isNotNull(), F.array(*segments))


def first_rows(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups in every task before it shuffles."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def top_k(codes: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest rows of each query, itself left out.

    Both inputs have (id, code); repeated rows count once.
    """
    segments = -(-bits // SEGMENT)
    want = k + 1  # a query may meet its own id
    rows = codes.where("code is not null").select("id", "code").distinct()
    ids = first_rows(rows, ["code"], ["id"], want).select("code", "id")
    ids = materialize(ids, "ids")
    # of codes at one distance those with the least ids come first; the second counts where the first is the query itself
    least = F.sort_array(F.collect_list("id"))  # at most k + 1
    sizes = ids.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("lead"), F.get(least, F.lit(1)).alias("second"))
    index = materialize(sizes.select("code", "n", "lead", "second", F.posexplode("code").alias("segment", "value")), "index")
    asked = queries.where("code is not null").select("id", "code").distinct()
    on_several = rows.join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("codes"))
    on_several = materialize(on_several.where("codes > 1").select(F.col("id").alias("owner")), "several")
    own = None
    if not on_several.isEmpty():
        own = ids.join(on_several, F.col("id") == F.col("owner")).select(F.col("owner").alias("__owner"), F.col("code").alias("__met"))
        own = materialize(own, "own")
    asked = materialize(asked.join(on_several, F.col("id") == F.col("owner"), "left").select("id", "code", "owner"), "queries")

    # a search is a distinct query code, or a query on several codes; bound is the distance of the last row wanted so far
    waiting = asked.select("code", "owner").distinct().withColumn("bound", F.lit(None).cast("int"))
    best = None
    done = []
    for radius in range(SEGMENT + 1):
        near = _probe(waiting, index, radius, bits)
        near = near.drop("second") if own is None else _without_own(near, own)
        near = near if best is None else near.unionByName(best)
        near = first_rows(near, ["code", "owner"], ["d", "lead"], want).drop("rank")
        near = materialize(near, "best")
        within = F.coalesce(F.sum(F.when(F.col("d") < segments * (radius + 1), F.col("n"))), F.lit(0))
        state = near.groupBy("code", "owner").agg(within.alias("sure"), F.sum("n").alias("met_rows"), F.max("d").alias("far"))
        state = state.withColumnsRenamed({"code": "__code", "owner": "__for"})
        of = F.expr("code = __code and owner <=> __for")
        covered = state.where(F.col("sure") >= want).select("__code", "__for")
        last = radius == SEGMENT
        done.append(near if last else near.join(covered, of, "left_semi"))
        if last:
            break
        bound = F.when(F.col("met_rows") >= want, F.col("far")).alias("bound")
        waiting = waiting.drop("bound").join(state, of, "left").where(f"sure is null or sure < {want}")
        waiting = materialize(waiting.select("code", "owner", bound), "open")
        best = near.join(covered, of, "left_anti")
        if waiting.isEmpty():
            break
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    # more ids than wanted may hang on the codes found; the nearest of them are the result
    found = found.withColumnsRenamed({"code": "__code", "owner": "__for"})
    rows = asked.join(found, F.expr("code = __code and owner <=> __for"))
    rows = rows.select(F.col("id").alias("query_id"), F.col("d"), F.col("met"))
    rows = rows.join(ids.select(F.col("code").alias("met"), F.col("id").alias("neighbour_id")), "met")
    rows = rows.where("not (neighbour_id <=> query_id)")
    out = first_rows(rows, ["query_id"], ["d", "neighbour_id"], k)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", F.col("d").cast("long").alias("distance"))


def _without_own(near: DataFrame, own: DataFrame) -> DataFrame:
    """``near`` without the rows of the ``owner`` of each search: one less where it stands on the code met."""
    near = near.join(own, F.expr("owner = __owner and met = __met"), "left")
    stands = F.col("__owner").isNotNull()
    lead = F.when(stands & (F.col("lead") == F.col("owner")), F.col("second")).otherwise(F.col("lead"))
    near = near.select("code", "owner", "d", "met", (F.col("n") - stands.cast("int")).alias("n"), lead.alias("lead"))
    return near.where("n > 0")


def _probe(waiting: DataFrame, index: DataFrame, radius: int, bits: int) -> DataFrame:
    """Pairs (code with owner, met) whose least segment distance is ``radius``, each from one segment only."""
    probes = waiting.select("code", "owner", "bound", F.posexplode("code").alias("segment", "value"))
    flips = [m for m in range(1 << min(SEGMENT, bits)) if m.bit_count() == radius]
    # one literal, folded into an array of integers by the optimiser
    every = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>")
    last = (bits - 1) // SEGMENT
    width = F.when(F.col("segment") == last, 1 << (bits - SEGMENT * last)).otherwise(1 << SEGMENT)
    probes = probes.select("code", "owner", "bound", "segment", "value", F.explode(every).alias("flip")).where(F.col("flip") < width)
    probes = probes.select("code", "owner", "bound", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    met = index.withColumnRenamed("code", "met")
    # the planner does not foresee how many rows the flips make, so it must not broadcast them
    pairs = probes.join(met.hint("merge"), ["segment", "value"]).withColumn(
        "apart", F.zip_with("code", "met", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    )
    once = (F.array_min("apart") == radius) & (F.array_position("apart", F.lit(radius)) == F.col("segment") + 1)
    distance = F.aggregate("apart", F.lit(0), lambda s, x: s + x)
    near = F.col("bound").isNull() | (distance <= F.col("bound"))
    return pairs.where(once & near).select("code", "owner", distance.alias("d"), "met", "n", "lead", "second")
