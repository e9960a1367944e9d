"""Category dictionaries as tables: (column, value, code), one form at every size.

Codes by rank need a global order: distinct (column, value) pairs are range-partitioned, sorted and
written with the number of their partition; a partition's place follows from the counts of those
before it, and a rank within it from a window over at most that partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, written

ROWS_PER_PART = 500_000
#: A dictionary of at most so many entries is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
SCHEMA = "column string, value string, code double"


def pairs_of(df: DataFrame, cols: list[str], null_as: str | None) -> DataFrame:
    """(column, value, n): how often each value occurs; NULL as ``null_as`` or not at all."""
    value = (lambda c: F.coalesce(F.col(c).cast("string"), F.lit(null_as))) if null_as is not None else (lambda c: F.col(c).cast("string"))
    items = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in cols])
    long = df.select(F.explode(items).alias("p")).select("p.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def ranked(pairs: DataFrame) -> DataFrame:
    """(column, value, code): the rank of each value within its column, in code-point order, from 0."""
    pairs = written(pairs.select("column", "value"), "dictionary-values")
    parts = max(1, -(-pairs.count() // ROWS_PER_PART))
    spread = written(pairs.repartitionByRange(parts, "column", "value").withColumn("part", F.spark_partition_id()), "dictionary-parts")
    sizes = spread.groupBy("column", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("column", "part", before.alias("before"))  # a row for each column and partition
    rank = F.row_number().over(Window.partitionBy("column", "part").orderBy("value"))
    out = spread.withColumn("rank", rank).join(sizes, ["column", "part"])
    return out.select("column", "value", (F.col("before") + F.col("rank") - 1).cast("double").alias("code"))


def save(table: DataFrame) -> dict:
    """Writes a dictionary; what a stage keeps of it."""
    path = scratch_path(table.sparkSession, "dictionary")
    table.write.parquet(path)
    return {"table": path, "rows": table.sparkSession.read.schema(SCHEMA).parquet(path).count()}


def load(spark: SparkSession, kept: dict) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(kept["table"])


def look_up(df: DataFrame, kept: dict, cols: list[str], null_as: str | None, unseen: float, kind: str) -> DataFrame:
    """``df`` with each of ``cols`` replaced by its code as ``kind``; values that have none: ``unseen``."""
    table = load(df.sparkSession, kept)
    for c in cols:
        if c not in df.columns:
            continue
        codes = table.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        if kept["rows"] <= BROADCAST_ROWS:
            codes = F.broadcast(codes)
        key: Column = F.col(c).cast("string")
        if null_as is not None:
            key = F.coalesce(key, F.lit(null_as))
        both = df.withColumn("__key", key).join(codes, F.col("__key") == F.col("__value"), "left")
        df = both.select(*[F.coalesce(F.col("__code"), F.lit(unseen)).cast(kind).alias(k) if k == c else F.col(k) for k in df.columns])
    return df
