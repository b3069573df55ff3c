"""Session-level helpers: checkpoints, size-checked lookups, row-preserving joins."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers of the session's executors.

    Not needed when it is installed on the cluster or passed with ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="tabstrata-pkg-"), "tabstrata")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "tabstrata"))
    _SHIPPED.add(app)


# A lookup table is broadcast only below this many rows; beyond it the join is salted.
BROADCAST_ROWS = 500_000
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, used for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without that
    setting (unit tests) falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="tabstrata-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, survives executor loss, and keeps column pruning and
    filter pushdown for the passes that follow.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more.

    Its cleaner does so when the driver collects garbage, which may be long after disks are full.
    """
    gc.collect()
    spark._jvm.System.gc()


class Steps:
    """Written states of an iteration: a new one replaces the one before, ``close`` deletes the last.

    A state is complete on the shared folder before its predecessor goes, so what is derived from
    either can always be computed again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        self.close()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self.path:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.path = None


#: Bytes in one Arrow batch of texts or blocks; Spark's own bound counts rows, however long they are.
BATCH = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on Arrow batches of its session are bounded by bytes, unless a bound is set."""
    conf, key, unset = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH + 1)
    if conf.get(key, unset) == unset:
        conf.set(key, str(BATCH))
    return df


#: Rows of a task that passes over training rows again and again.
ROWS_PER_TASK = 250_000


def fewer_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows in no more partitions than iterative passes have use for.

    Every task of a pass starts a Python runner and allocates the pages of an aggregation, some tenths of a
    second whatever its rows. All cores stay busy, and a task streams its rows, so its memory doesn't grow.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, -(-rows // ROWS_PER_TASK)))


#: Rows a core that fits may hold side by side.
ROWS_AT_ONCE = 4 * ROWS_PER_TASK


def side_by_side(df: DataFrame, fits: int) -> int:
    """How many of some fits on ``df`` run at once.

    Fits of few rows wait between short jobs for the driver most of the time. On many rows one fit keeps all cores
    busy, and what several fits cache, shuffle and spill at a time would only add up.
    """
    rows = max(1, df.count())
    return max(1, min(fits, df.sparkSession.sparkContext.defaultParallelism * ROWS_AT_ONCE // rows))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, n: int) -> bool:
    """True when ``df`` has at most ``n`` rows; stops reading soon after ``n``."""
    return df.limit(n + 1).count() <= n


#: Rows up to which a lookup is held by the plans themselves.
LOCAL_ROWS = 1_000


def held(df: DataFrame) -> DataFrame:
    """``df``, cached; up to ``LOCAL_ROWS`` rows as constants of the plan, which no job has to gather again.

    Otherwise every job that broadcasts the lookup would start a task for each of its partitions.
    """
    df = df.persist()
    rows = df.limit(LOCAL_ROWS + 1).toArrow()
    if rows.num_rows > LOCAL_ROWS:
        return df
    df.unpersist()
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: list[str],
    limit: int = BROADCAST_ROWS,
    salts: int = SALTS,
    null_safe: bool = False,
) -> DataFrame:
    """Left join of a large ``df`` with a ``table`` unique on ``on``, keeping every row of ``df``.

    A table of checked size is broadcast, so the big side is not shuffled. A larger one is joined
    on (key, salt): the big side spreads each key over ``salts`` buckets, so a key holding a third
    of the rows does not land in one task, and the table is repeated once per salt.
    """
    table = held(table)  # counted here, joined later
    small = at_most(table, limit)
    renamed = table.select(
        *[F.col(c).alias(f"__k_{c}") if c in on else F.col(c) for c in table.columns]
    )

    def match(c):
        left, right = df[c], renamed[f"__k_{c}"]
        return left.eqNullSafe(right) if null_safe else left == right

    keys = [f"__k_{c}" for c in on]
    if small:
        cond = match(on[0])
        for c in on[1:]:
            cond = cond & match(c)
        return df.join(F.broadcast(renamed), cond, "left").drop(*keys)
    # the row's number in its partition: equal rows of a hot key get different salts, and as the table
    # stands at every salt it doesn't matter which one a row gets when a task is run again
    df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    renamed = renamed.withColumn("__ksalt", F.explode(every))
    cond = df["__salt"] == renamed["__ksalt"]
    for c in on:
        cond = cond & match(c)
    return df.join(renamed, cond, "left").drop("__salt", "__ksalt", *keys)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a result whose size is a model parameter (classes, bins, coefficients), checked."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; it does not fit a driver-side parameter")
    return rows
