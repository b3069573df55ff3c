"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the expected number of copies of each of its documents, up
to a document's own weight. The whole part of it is allocated for certain; the rest is the inclusion
probability p of one more copy. Documents are ranked by the odds u / (1 - u) of a random number
over the inclusion odds p / (1 - p), and the first ranks are taken until the source's remaining
words are filled: a fixed-size sample (in words) with unequal probabilities.

Scale: only (source, size, rank) rows are kept, in a table on the shared folder. The cut of a source
is found in a histogram of the ranks, refined once, so only 1 / 2**24 of a hot source is sorted in one
task; rows that share a rank are cut by a histogram of their ties, in which equal rows are one item with a count. Sources are a
table too, and the driver sees two sums for every round of resharing.

Cases: null text has size 0; documents of size 0 are taken as often as others of their source and
weigh nothing; a null source is a source, the last one; random numbers derive from the id and seed,
so reruns agree. Rows of equal or null ids in one source share a rank and are drawn one by one, by the hash of their text (``tie``);
of wholly equal rows as many are drawn as are wanted, no matter which. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabstrata.functions.hashing import unit_hash
from tabstrata.llm.common import one
from tabstrata.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of one refinement of the rank histogram.
BINS = 1 << 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(values: DataFrame, column: str) -> DataFrame:
    """``values`` plus ``number``: 0, 1, ... in the order of ``column``, nulls last.

    Rows are range-partitioned and numbered inside partitions; only partition sizes meet in one task.
    """
    ordered = F.col(column).asc_nulls_last()
    cut = values.repartitionByRange(ordered).sortWithinPartitions(ordered)
    cut = materialize(cut.withColumn("at", F.monotonically_increasing_id()), "numbered")
    cut = cut.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    before = cut.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    out = cut.join(before, "part")
    return out.withColumn("number", F.col("at") + F.col("before")).drop("part", "at", "before")


def targets(sources: DataFrame, weights: list[int], most: int = 3) -> DataFrame:
    """``sources`` (source, source_size) plus ``weight`` and ``target``.

    The whole size is shared by weight; a target stops at ``most`` times the source's size, and the
    excess is shared again until none is above.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = numbered(sources, "source")
    table = table.withColumn("weight", F.get(cycle, F.pmod("number", F.lit(len(weights))).cast("int"))).drop("number")
    table = materialize(table, "sources")
    total = one(table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")))["n"]
    share, capped = 0.0, None
    full = F.col("source_size") * most
    while True:
        above = F.col("weight") * F.lit(share) > full
        sums = one(
            table.agg(
                F.sum(F.when(above, full).otherwise(0)).alias("full"),
                F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"),
                F.count_if(above).alias("capped"),
            )
        )
        if sums["capped"] == capped or not sums["weight"]:
            break
        share, capped = (total - sums["full"]) / sums["weight"], sums["capped"]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(share), full.cast("double")))


def _weight(df: DataFrame) -> Column:
    return F.coalesce("doc_weight", F.lit(1.0)) if "doc_weight" in df.columns else F.lit(1.0)


def _tie(df: DataFrame) -> Column:
    return F.col("tie") if "tie" in df.columns else F.xxhash64("size")


def _ranked(df: DataFrame, seed: int, most: int) -> DataFrame:
    """Adds the certain copies and the Pareto rank: null where nothing is left to chance.

    ``rank`` is q / (1 + q) of the ratio of odds q, which has the same order and lies in [0, 1).
    """
    expected = F.least(F.col("rate") * _weight(df), F.lit(float(most)))
    df = df.withColumn("sure", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    u = unit_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    odds = (u / (1.0 - u)) / (F.col("p") / (1.0 - F.col("p")))
    return df.withColumn("rank", F.when(F.col("p") > 0, odds / (1.0 + odds)))


def _crossing(bins: DataFrame, need: DataFrame, column: str) -> DataFrame:
    """Per source the first bin in which the running size reaches ``need``, and what is left to it."""
    w = W.partitionBy("source").orderBy(column).rowsBetween(W.unboundedPreceding, 0)
    run = bins.withColumn("upto", F.sum("size").over(w))
    joined = run.join(need, F.col("source").eqNullSafe(F.col("__source"))).where("need > 0 and upto >= need")
    first = joined.groupBy("__source").agg(F.min(F.struct(column, "upto", "size", "need", "start")).alias("x"))
    left = F.col("x.need") - F.col("x.upto") + F.col("x.size")
    return first.select("__source", f"x.{column}", left.alias("need"), "x.start")


def plan(sized: DataFrame, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source (``__source``): source_size, target, rate, and where the drawn rows end.

    ``edge``, ``edge_id`` and ``edge_tie`` are the rank, id and tie of the rows that cross the line, of which ``edge_take``
    of ``edge_rows`` are drawn; without a tie all rows of the edge are.
    ``sized`` has doc_id, source, size and optionally ``doc_weight`` (positive), by which documents
    of a source differ in their expected copies, and ``tie``, a 64-bit number that tells rows of equal ids apart.
    """
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * _weight(sized)).alias("mass")
    )
    table = targets(sums, list(weights), most)
    rate = F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0)
    table = table.select(F.col("source").alias("__source"), "source_size", "target", rate.alias("rate"))
    table = materialize(table, "targets")
    same = F.col("source").eqNullSafe(F.col("__source"))
    df = _ranked(sized.withColumn("tie", _tie(sized)).join(table, same).drop("__source"), seed, most)
    low = F.floor(F.col("rank") * BINS)
    df = df.withColumn("low", low).withColumn("fine", F.floor((F.col("rank") * BINS - low) * BINS))
    df = materialize(df.select("doc_id", "source", "size", "tie", "sure", "rank", "low", "fine", "target"), "ranked")

    left = df.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("need"))
    need = left.select(F.col("source").alias("__source"), "need", F.lit(0.0).alias("start"))
    rows = df.where("rank is not null").select("doc_id", "source", "size", "tie", "rank", "low", "fine")
    for column, width in (("low", 1 / BINS), ("fine", 1 / BINS**2)):
        bins = rows.groupBy("source", column).agg(F.sum("size").alias("size"))
        cut = materialize(_crossing(bins, need, column), "cut")
        need = cut.select("__source", "need", (F.col("start") + F.col(column) * F.lit(width)).alias("start"))
        own = same & (F.col(column) == F.col("__bin"))
        rows = rows.join(cut.select("__source", F.col(column).alias("__bin")), own).drop("__source", "__bin")
    # the rows of one id that cross the line, and what is left to it; all of the last bin if none do
    groups = _running(rows.groupBy("source", "rank", "doc_id").agg(F.sum("size").alias("size")), ["rank", "doc_id"]).join(need, same)
    left = F.col("need") - F.col("upto") + F.col("size")
    ends = groups.groupBy("__source").agg(
        F.min(F.when(F.col("upto") > F.col("need"), F.struct("rank", "doc_id", left.alias("need")))).alias("x"),
        F.max(F.struct("rank", "doc_id")).alias("last"),
    )
    ends = ends.select(
        "__source", F.coalesce("x.rank", "last.rank").alias("edge"),
        F.when(F.col("x").isNull(), F.col("last.doc_id")).otherwise(F.col("x.doc_id")).alias("edge_id"), F.col("x.need").alias("need"),
    )
    ends = materialize(ends, "ends")
    # among them the tie, by a histogram of its upper bits first
    at = same & (F.col("rank") == F.col("edge")) & F.col("doc_id").eqNullSafe(F.col("edge_id"))
    rows = rows.join(ends.where("need is not null"), at).select("source", "size", "tie", F.shiftright("tie", 52).alias("part"), "need")
    part = _running(rows.groupBy("source", "part").agg(F.sum("size").alias("size"), F.first("need").alias("need")), ["part"])
    part = part.where("upto > need").groupBy("source").agg(F.min(F.struct("part", left.alias("need"))).alias("x"))
    part = part.select(F.col("source").alias("__source"), F.col("x.part").alias("__part"), F.col("x.need").alias("need"))
    items = rows.drop("need").join(part, same & (F.col("part") == F.col("__part"))).groupBy("source", "tie", F.col("size").alias("each"))
    items = items.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.first("need").alias("need"))
    items = _running(items, ["tie", "each"]).where("upto > need")
    first = items.groupBy("source").agg(F.min(F.struct("tie", "each", "n", left.alias("need"))).alias("x"))
    # one more is drawn if that comes nearer
    whole = F.floor(F.col("x.need") / F.col("x.each"))
    rest = F.col("x.need") - whole * F.col("x.each")
    more = F.when((rest > 0) & (F.col("x.each") - rest <= rest), 1).otherwise(0)
    first = first.select(
        F.col("source").alias("__own"), F.col("x.tie").alias("edge_tie"), (whole + more).alias("edge_take"), F.col("x.n").alias("edge_rows")
    )
    ends = ends.drop("need").join(first, F.expr("__source <=> __own"), "left").drop("__own").withColumnRenamed("__source", "__own")
    return materialize(table.join(ends, F.expr("__source <=> __own"), "left").drop("__own"), "mix")


def _running(sums: DataFrame, by: list[str]) -> DataFrame:
    """``sums`` plus ``upto``: the size of the source's rows up to and with this one."""
    w = W.partitionBy("source").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    return sums.withColumn("upto", F.sum("size").over(w))


def _first_of_equals(df: DataFrame) -> DataFrame:
    """``df`` plus ``drawn``: true for ``edge_take`` rows of each source, in an order that the written rows keep.

    Rows are numbered inside the tasks that wrote them; only their numbers by task meet.
    """
    rows = materialize(df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "equals")
    parts = rows.groupBy(F.col("source").alias("__own"), F.col("__part").alias("__of")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__own").orderBy("__of").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    parts = parts.withColumn("__before", before)
    number = F.row_number().over(W.partitionBy("source", "__part").orderBy("__at")) + F.col("__before")
    rows = rows.join(parts, F.expr("source <=> __own and __part = __of")).withColumn("drawn", number <= F.col("edge_take"))
    return rows.select(*df.columns, "drawn")


def copies(sized: DataFrame, mix: DataFrame, seed: int = 42, most: int = 3) -> DataFrame:
    """``sized`` plus source_size, target and ``copies`` (0 to ``most``) by a ``plan``."""
    own = sized.withColumn("__tie", _tie(sized))
    df = _ranked(own.join(mix, F.col("source").eqNullSafe(F.col("__source")), "left"), seed, most)
    on_edge = F.col("rank") == F.col("edge")
    same_id = F.col("doc_id").eqNullSafe(F.col("edge_id"))
    first_ids = ~same_id & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") < F.col("edge_id"), F.lit(False)))
    equals = on_edge & same_id & (F.col("__tie") == F.col("edge_tie"))
    first_ties = same_id & (F.col("edge_tie").isNull() | (F.col("__tie") < F.col("edge_tie")))
    all_equals = equals & (F.col("edge_take") >= F.col("edge_rows"))
    drawn = F.coalesce((F.col("rank") < F.col("edge")) | (on_edge & (first_ids | first_ties)) | all_equals, F.lit(False))
    if mix.where("edge_take > 0 and edge_take < edge_rows").isEmpty():
        df = df.withColumn("drawn", drawn)
    else:
        some = F.coalesce(equals & F.expr("edge_take > 0 and edge_take < edge_rows"), F.lit(False))
        df = df.where(~some).withColumn("drawn", drawn).unionByName(_first_of_equals(df.where(some)))
    return df.withColumn("copies", (F.col("sure") + F.when(F.col("drawn"), 1).otherwise(0)).cast("int")).drop(
        "__source", "__tie", "rate", "sure", "p", "rank", "edge", "edge_id", "edge_tie", "edge_take", "edge_rows", "drawn"
    )


def mixed(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` in the mix: each row as many times as it is taken, same columns."""
    tie = F.xxhash64("text").alias("tie")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), tie)
    sized = materialize(sized, "sizes")
    table = plan(sized, seed, weights, most)
    names = docs.columns
    own = docs.select("doc_id", "source", tie, F.struct(*names).alias("__row"))
    taken = copies(own, table, seed, most).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
