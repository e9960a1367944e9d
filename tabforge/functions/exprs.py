"""Small column-expression helpers shared by every operator (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing(df: DataFrame, col: str) -> Column:
    """NULL, or NaN for floating columns (the pandas notion of missing)."""
    c = F.col(col)
    dt = df.schema[col].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def number(col: str) -> Column:
    """``col`` as a double with NaN taken as missing: what every numeric fit reads."""
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL in floating columns so aggregates skip them."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def seeded_hash(key_cols, seed: int = 42) -> Column:
    """md5 hex of the key text and the seed: a deterministic random order, same in any engine.

    Keys are joined with '|' and the seed appended (``md5(k1|k2|...|seed)``).
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key_cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_rank_value(hex_col: Column) -> Column:
    """First 15 hex digits of an md5 as a non-negative bigint (uniform on [0, 2^60))."""
    return F.conv(F.substring(hex_col, 1, 15), 16, 10).cast("long")


def rnd(c: Column, places: int = 6) -> Column:
    return F.round(c.cast("double"), places)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def inject_nulls(df: DataFrame, col: str, key: str, modulus: int = 10, remainder: int = 3) -> DataFrame:
    """Fixture helper: NULL out ``col`` where ``key % modulus == remainder`` (every row is kept)."""
    dt = df.schema[col].dataType
    expr = F.when(F.col(key) % modulus == remainder, F.lit(None).cast(dt)).otherwise(F.col(col))
    return df.withColumn(col, expr)
