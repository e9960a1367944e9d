"""Column roles (numeric / categorical / other) decided from the schema alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
OTHER = "other"


def role_of(dtype: T.DataType, bool_numeric: bool = False) -> str:
    if isinstance(dtype, T.BooleanType):
        return NUMERIC if bool_numeric else OTHER
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.StringType):
        return CATEGORICAL
    return OTHER


def roles(df: DataFrame, bool_numeric: bool = False) -> dict[str, str]:
    return {f.name: role_of(f.dataType, bool_numeric) for f in df.schema.fields}


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, r in roles(df).items() if r == NUMERIC and c not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, r in roles(df).items() if r == CATEGORICAL and c not in exclude]


def is_float(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType))


def is_numeric(df: DataFrame, col: str) -> bool:
    return role_of(df.schema[col].dataType) == NUMERIC


def present(df: DataFrame, cols) -> list[str]:
    names = set(df.columns)
    return [c for c in cols if c in names]
