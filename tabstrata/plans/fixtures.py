"""The labelled observation table, derived from the star-schema tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstrata.operators.encode import LabelCodes
from tabstrata.operators.folds import stratified_folds
from tabstrata.runtime import fewer_tasks
from tabstrata.sources.tables import CATEGORIES, NUMERIC

CLASSES = ["GALAXY", "QSO", "STAR"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with line items.

    Line items are aggregated first, so the joins see one row per order; the shuffle on the order
    key serves the aggregation and the join with orders alike.
    """
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    per_order = li.groupBy("l_orderkey").agg(
        F.avg("l_discount").alias("alpha"),
        F.avg("l_tax").alias("delta"),
        F.sum("l_quantity").alias("u"),
        F.max("l_quantity").alias("g"),
        F.avg("l_quantity").alias("r"),
        F.min("l_quantity").alias("i"),
        F.count(F.lit(1)).alias("n"),
        F.sum("l_extendedprice").alias("amount"),
    )
    joined = per_order.join(orders, per_order["l_orderkey"] == orders["o_orderkey"]).join(
        customer, orders["o_custkey"] == customer["c_custkey"]
    )
    population = (
        F.when(F.col("n") <= 3, "FEW").when(F.col("n") <= 5, "SOME").otherwise("MANY")
    )
    signal = (
        F.when(F.col("amount") < 120000, "GALAXY").when(F.col("amount") < 240000, "QSO").otherwise("STAR")
    )
    return joined.select(
        F.col("o_orderkey").alias("id"),
        "alpha",
        "delta",
        "u",
        "g",
        "r",
        "i",
        F.col("n").cast("double").alias("z"),
        (F.col("o_totalprice") / 100000.0).alias("redshift"),
        F.col("o_orderpriority").alias("spectral_type"),
        population.alias("galaxy_population"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("noise_class"),
        signal.alias("signal_class"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features and class_encoded (codes of ``signal_class``)."""
    return LabelCodes(CLASSES).encode(observations(spark, sf_dir), "signal_class", "class_encoded")


def folded(spark: SparkSession, sf_dir: str, k: int = 5, seed=42) -> DataFrame:
    """Labelled rows with a stratified fold."""
    # ranking reads its input twice, for counts and for rows; both share the exchanges below the
    # joins, and only the columns a caller selects are carried along
    return stratified_folds(labelled(spark, sf_dir), "id", "class_encoded", k, seed)


def training_frame(spark: SparkSession, sf_dir: str, k: int = 5, seed=42, extra=()) -> DataFrame:
    """The columns learners use, with fold, cached for the passes of a fit."""
    cols = ["id", *NUMERIC, *CATEGORIES, "class_encoded", "fold", *extra]
    most = table(spark, sf_dir, "orders").count()  # from the footers; an order is one row at most
    return fewer_tasks(folded(spark, sf_dir, k, seed).select(*cols), most).persist()


# the same tables as SQL common table expressions --------------------------------------------------
OBS_SQL = """obs as (
  select o.o_orderkey as id, avg(l.l_discount) as alpha, avg(l.l_tax) as delta,
         sum(l.l_quantity) as u, max(l.l_quantity) as g, avg(l.l_quantity) as r,
         min(l.l_quantity) as i, cast(count(*) as double) as z,
         any_value(o.o_totalprice) / 100000.0 as redshift,
         any_value(o.o_orderpriority) as spectral_type,
         case when count(*) <= 3 then 'FEW' when count(*) <= 5 then 'SOME' else 'MANY' end
           as galaxy_population,
         any_value(c.c_mktsegment) as segment, any_value(o.o_orderstatus) as noise_class,
         case when sum(l.l_extendedprice) < 120000 then 'GALAXY'
              when sum(l.l_extendedprice) < 240000 then 'QSO' else 'STAR' end as signal_class
  from orders o join customer c on o.o_custkey = c.c_custkey
                join lineitem l on l.l_orderkey = o.o_orderkey
  group by o.o_orderkey)"""

LAB_SQL = (
    OBS_SQL
    + """, lab as (
  select *, case signal_class when 'GALAXY' then 0 when 'QSO' then 1 else 2 end as y from obs)"""
)


def fold_sql(source: str, out: str = "fold", k: int = 5, seed=42, strata: str | None = "y") -> str:
    part = f"partition by {strata} " if strata else ""
    return (
        f"select *, cast((row_number() over ({part}order by md5('{seed}|' || cast(id as varchar)), id)"
        f" - 1) % {k} as integer) as {out} from {source}"
    )


FOLD_SQL = LAB_SQL + ", f as (" + fold_sql("lab") + ")"


def unit_sql(seed, *columns: str) -> str:
    """SQL text of :func:`tabstrata.functions.hashing.unit_hash`."""
    text = " || '|' || ".join([f"'{seed}'"] + [f"cast({c} as varchar)" for c in columns])
    return f"(cast(('0x' || substr(md5({text}), 1, 8)) as bigint) / 4294967296e0)"
