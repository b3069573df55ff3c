"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ["alpha", "delta", "u", "g", "r", "i", "z", "redshift"]
CATEGORIES = ["spectral_type", "galaxy_population"]


def observation_schema(with_class: bool = True) -> T.StructType:
    """Explicit schema of the labelled input; nothing is inferred from a scan."""
    fields = [T.StructField("id", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in NUMERIC]
    fields += [T.StructField(c, T.StringType()) for c in CATEGORIES]
    if with_class:
        fields.append(T.StructField("class", T.StringType()))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """CSV with a header and a declared schema; rows are identified by ``key``."""
    if key not in schema.fieldNames():
        raise ValueError(f"key column {key!r} is not in the schema")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> str:
    df.select(*(columns or df.columns)).write.option("header", True).csv(path)
    return path


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str) -> str:
    """Writes to a new path and fails when it exists, so a stage never overwrites its input."""
    df.write.mode("error").parquet(path)
    return path


def align(left: DataFrame, right: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """Tables meet by key, never by row position."""
    return left.join(right, key, how)


def split_xy(df: DataFrame, label: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    return df.drop(label), df.select(key, F.col(label))
