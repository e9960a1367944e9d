"""Model-input checks and one-row preset inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import missing, seeded_hash


def validate_features(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(column, missing_count) for every feature or target column holding missing values;
    an empty result means the table can be fitted. One aggregate."""
    if not features:
        raise ValueError("at least one feature is required")
    cols = list(features) + [target]
    wide = df.agg(*[F.count_if(missing(df, c)).cast("long").alias(f"m{i}") for i, c in enumerate(cols)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
                                           for i, c in enumerate(cols)])).alias("e")).select("e.*")
    return long.where(F.col("missing_count") > 0)


def preset_rows(raw_profile: dict, spark: SparkSession, presets=("mean", "min", "median"), raw_df: DataFrame | None = None,
                key: str | None = None, seed: int = 42) -> DataFrame:
    """One row per preset built from the fitted raw profile: numeric columns at their mean /
    minimum / median, text columns at their first sorted category. With ``raw_df`` also ``random``, a row
    of it: the first in the order of md5(key|seed), so another seed gives another row."""
    num = list(raw_profile["numeric"])
    cat = list(raw_profile["categorical"])
    rows = []
    for p in presets:
        rows.append(tuple([p] + [float(raw_profile["numeric"][c][p]) for c in num]
                          + [raw_profile["categorical"][c]["first"] for c in cat]))
    schema = "preset string, " + ", ".join([f"`{c}` double" for c in num] + [f"`{c}` string" for c in cat])
    out = spark.createDataFrame(rows, schema)
    if raw_df is None:
        return out
    drawn = raw_df.withColumn("__h", seeded_hash([key], seed)).orderBy("__h", key).limit(1)
    return out.union(drawn.select(F.lit("random"), *[F.col(c).cast("double") for c in num], *[F.col(c).cast("string") for c in cat]))
