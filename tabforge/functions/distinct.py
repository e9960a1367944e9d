"""Distinct values up to a limit, for questions like "two?" or "more than ten?".

An exact distinct count shuffles every distinct value. Here each column has a sketch of frequent items
of fixed size, merged in one aggregate: it is exact as long as it never had to let an item go, which
shows in its counts adding up to the rows; if they do not, there are more values than it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKETCHED = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.DecimalType)


def distinct_up_to(df: DataFrame, cols: list[str], limit: int) -> dict[str, int]:
    """Per column the number of distinct values that are not NULL, or ``limit + 1`` if there are more
    (NaN is a value, 0.0 and -0.0 are one)."""
    if not cols:
        return {}
    want = limit + 2  # NULL takes one place
    room = 1 << max(6, (4 * want).bit_length())
    aggs = []
    for i, c in enumerate(cols):
        kind = df.schema[c].dataType
        x = F.col(c) if isinstance(kind, _SKETCHED) else F.col(c).cast("string")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            x = x.cast("double") + F.lit(0.0)
        aggs += [F.call_function("approx_top_k", x, F.lit(want), F.lit(room)).alias(f"k{i}"), F.count(c).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        found = [x["count"] for x in r[f"k{i}"] or [] if x["item"] is not None]
        exact = sum(found) == r[f"n{i}"] and len(found) <= limit
        out[c] = len(found) if exact else limit + 1
    return out


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_distinct) exactly: one group-by of (column, value) pairs, combined before the shuffle."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    value = {c: (F.col(c) + F.lit(0.0) if c in floats else F.col(c)).cast("string") for c in cols}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value[c].alias("value")) for c in cols])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    have = long.groupBy("column").agg(F.count("*").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(have, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))
