"""Cleaning: duplicates, column drops, missing-row/column drops, role selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distinct import distinct_up_to
from ..functions.exprs import missing
from ..functions.roles import categorical_columns, numeric_columns, present
from ..plans.stage import Stage, register
from .profile import constant_columns


def dedup(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first",
          order_by: list[str] | str | None = None) -> DataFrame:
    """Drop duplicate rows on ``subset`` (all columns by default).

    keep="first"/"last": the row with the smallest/largest ``order_by`` key survives;
    keep=False: every row whose key repeats is dropped. Implemented as a hash aggregate
    (``min``/``max`` of a struct led by the order key) so map-side partial aggregation
    collapses hot keys before the shuffle; NULL and NaN keys compare equal, as in pandas.
    """
    subset = list(subset) if subset else list(df.columns)
    order_by = [order_by] if isinstance(order_by, str) else list(order_by or [])
    others = [c for c in df.columns if c not in subset]
    if keep is False or keep == "none":
        g = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("__n"),
                                    *([F.any_value(F.struct(*others)).alias("__r")] if others else []))
        out = g.where(F.col("__n") == 1)
        return out.select(*[F.col(c) if c in subset else F.col(f"__r.{c}").alias(c) for c in df.columns])
    if not others:
        return df.dropDuplicates(subset)
    if not order_by:
        raise ValueError("keep='first'/'last' needs an explicit order_by key")
    pick = F.min if keep == "first" else F.max
    ordered = [c for c in order_by] + [c for c in others if c not in order_by]
    g = df.groupBy(*subset).agg(pick(F.struct(*[F.col(c).alias(c) for c in ordered])).alias("__r"))
    return g.select(*[F.col(c) if c in subset else F.col(f"__r.{c}").alias(c) for c in df.columns])


def duplicates_removed(before: DataFrame, after: DataFrame) -> int:
    return before.count() - after.count()


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*present(df, cols))


def fit_drop(cols: list[str]) -> Stage:
    return Stage("drop", {"columns": list(cols)})


@register("drop")
def _apply_drop(df, p):
    return df.drop(*present(df, p["columns"]))


def drop_constant(df: DataFrame) -> tuple[DataFrame, list[str]]:
    consts = constant_columns(df)
    return df.drop(*consts), consts


def drop_missing_rows(df: DataFrame, how: str = "any", thresh: int | None = None,
                      subset: list[str] | None = None) -> DataFrame:
    """pandas ``dropna(axis=0)``: NULL and NaN both count as missing."""
    return df.na.drop(how=how, thresh=thresh, subset=subset)


def _missing_per_column(df: DataFrame):
    aggs = [F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    r = df.agg(*aggs, F.count(F.lit(1)).alias("__rows")).collect()[0]
    return {c: r[f"m{i}"] for i, c in enumerate(df.columns)}, r["__rows"]


def drop_missing_columns(df: DataFrame, how: str = "any", thresh: int | None = None) -> tuple[DataFrame, list[str]]:
    """pandas ``dropna(axis=1)``: one count aggregate decides the columns."""
    miss, rows = _missing_per_column(df)
    if thresh is not None:
        gone = [c for c, m in miss.items() if rows - m < thresh]
    elif how == "all":
        gone = [c for c, m in miss.items() if rows > 0 and m == rows]
    else:
        gone = [c for c, m in miss.items() if m > 0]
    return df.drop(*gone), gone


def drop_high_missing(df: DataFrame, threshold_pct: float = 50.0) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share is at least ``threshold_pct`` percent."""
    miss, rows = _missing_per_column(df)
    gone = [c for c, m in miss.items() if rows > 0 and m / rows * 100.0 >= threshold_pct]
    return df.drop(*gone), gone


def select_numeric(df: DataFrame, exclude=()) -> DataFrame:
    return df.select(*numeric_columns(df, exclude))


def select_categorical(df: DataFrame, exclude=()) -> DataFrame:
    return df.select(*categorical_columns(df, exclude))


def candidate_scale_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns with more than two distinct non-null values; all numeric if none."""
    num = numeric_columns(df, exclude)
    if not num:
        return []
    found = distinct_up_to(df, num, 2)
    picked = [c for c in num if found[c] > 2]
    return picked or num


def filter_predictions(pred: DataFrame, which: str = "all", flag: str = "Accurate") -> DataFrame:
    if which == "correct":
        return pred.where(F.col(flag))
    if which == "misclassified":
        return pred.where(~F.col(flag))
    return pred
