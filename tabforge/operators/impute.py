"""Missing-value imputation: one fused statistics job per fit, a ``coalesce`` per column to apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import missing
from ..functions.order_stats import quantiles
from ..functions.roles import NUMERIC, categorical_columns, numeric_columns, present, role_of
from ..plans.stage import Stage, register


def _is_integral(dt):
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-missing value per column, smallest value on ties (typed order:
    numbers numerically, text by code point). Three jobs at most: whole numbers, other numbers and text,
    each a partial-aggregated (column, value) count then a per-column min over (-count, value)."""
    out = {}
    num = [c for c in cols if role_of(df.schema[c].dataType) == NUMERIC]
    whole = [c for c in num if _is_integral(df.schema[c].dataType)]
    txt = [c for c in cols if c not in num]
    for group, cast in ((whole, "bigint"), ([c for c in num if c not in whole], "double"), (txt, "string")):
        if not group:
            continue
        items = [F.struct(F.lit(c).alias("column"),
                          F.when(~missing(df, c), F.col(c).cast(cast)).alias("value")) for c in group]
        long = df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
        vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
        best = vc.groupBy("column").agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col("value").alias("v"))).alias("b"))
        for r in best.collect():
            out[r["column"]] = r["b"]["v"]
    for c in num:
        if c in out and out[c] is not None and _is_integral(df.schema[c].dataType):
            out[c] = int(out[c])
    return out


def fit_impute(df: DataFrame, cols: list[str], strategy: str = "mean", fill_value=None,
               quantile_method: str = "auto", n_neighbors: int = 5, max_iter: int = 10,
               scope: str = "features", key: str | None = None) -> Stage:
    """Fit an imputation stage.

    strategy: mean / median (numeric only), most_frequent / mode (any type, typed fill),
    constant (typed, checked), knn / iterative. These two see all numeric ``cols`` together; with one
    column, or with ``scope="column"``, they see only the column itself, which is exactly the column
    mean (no other feature exists to measure distance or regress on). ``key``: a unique column that
    decides between neighbours at equal distance.
    """
    cols = present(df, cols)
    strategy = strategy.lower()
    fills = {}
    together = [c for c in cols if role_of(df.schema[c].dataType) == NUMERIC]
    if scope != "column" and len(together) > 1:
        if strategy in ("iterative", "mice"):
            from .mice import fit_mice
            return fit_mice(df, together, max_iter=max_iter)
        if strategy == "knn":
            from .knn_impute import fit_knn_impute
            return fit_knn_impute(df, together, n_neighbors, key)
    if strategy in ("mean", "median", "knn", "iterative", "mice"):
        num = [c for c in cols if role_of(df.schema[c].dataType) == NUMERIC]
        if strategy == "median":
            q = quantiles(df.select(*[F.when(~missing(df, c), F.col(c)).alias(c) for c in num]), num, [0.5],
                          method=quantile_method)
            fills = {c: q[(c, (), 0.5)] for c in num}
        elif num:
            r = df.agg(*[F.avg(F.when(~missing(df, c), F.col(c).cast("double"))).alias(f"a{i}")
                         for i, c in enumerate(num)]).collect()[0]
            fills = {c: r[f"a{i}"] for i, c in enumerate(num)}
        fills = {c: (None if v is None else float(v)) for c, v in fills.items()}
        return Stage("impute", {"strategy": strategy, "fills": fills, "as_double": True})
    if strategy in ("most_frequent", "mode"):
        return Stage("impute", {"strategy": "most_frequent", "fills": column_modes(df, cols), "as_double": False})
    if strategy == "constant":
        value = "Missing" if fill_value is None else fill_value
        for c in cols:
            dt = df.schema[c].dataType
            if role_of(dt) == NUMERIC and not isinstance(value, (int, float)):
                try:
                    float(value)
                except (TypeError, ValueError):
                    raise ValueError(f"constant {value!r} cannot fill numeric column {c!r}") from None
        return Stage("impute", {"strategy": "constant", "fills": {c: value for c in cols}, "as_double": False})
    raise ValueError(f"unknown imputation strategy {strategy!r}")


@register("impute")
def _apply_impute(df: DataFrame, p: dict) -> DataFrame:
    fills = {c: v for c, v in p["fills"].items() if c in df.columns and v is not None}
    if not fills:
        return df
    out = []
    for f in df.schema.fields:
        c = f.name
        if c not in fills:
            out.append(F.col(c))
            continue
        v = fills[c]
        if p.get("as_double"):
            out.append(F.when(missing(df, c), F.lit(float(v))).otherwise(F.col(c).cast("double")).alias(c))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(F.col(c), F.lit(str(v))).alias(c))
        elif _is_integral(f.dataType) and isinstance(v, float) and not float(v).is_integer():
            out.append(F.when(missing(df, c), F.lit(float(v))).otherwise(F.col(c).cast("double")).alias(c))
        else:
            out.append(F.when(missing(df, c), F.lit(v).cast(f.dataType)).otherwise(F.col(c)).alias(c))
    return df.select(*out)


def impute(df: DataFrame, cols: list[str], strategy: str = "mean", fill_value=None, **kw) -> tuple[DataFrame, Stage]:
    st = fit_impute(df, cols, strategy, fill_value, **kw)
    return st.apply(df), st


def fit_impute_global(df: DataFrame, numeric_strategy: str = "mean", exclude=()) -> Stage:
    """Numeric columns by ``numeric_strategy``, every other imputable column by mode; one stage."""
    num = numeric_columns(df, exclude)
    cat = categorical_columns(df, exclude)
    n = fit_impute(df, num, numeric_strategy).params["fills"] if num else {}
    m = column_modes(df, cat) if cat else {}
    return Stage("impute_multi", {"parts": [{"fills": n, "as_double": True}, {"fills": m, "as_double": False}]})


def fit_impute_plan(df: DataFrame, plan: dict) -> Stage:
    """Per-column strategy map ``{col: strategy or ("constant", value)}``, fitted together."""
    by = {}
    for c, s in plan.items():
        key = s if isinstance(s, str) else tuple(s)
        by.setdefault(key, []).append(c)
    parts = []
    for key, cols in by.items():
        if isinstance(key, tuple):
            st = fit_impute(df, cols, key[0], key[1])
        else:
            st = fit_impute(df, cols, key)
        parts.append({"fills": st.params["fills"], "as_double": st.params["as_double"]})
    return Stage("impute_multi", {"parts": parts})


@register("impute_multi")
def _apply_impute_multi(df, p):
    for part in p["parts"]:
        df = _apply_impute(df, part)
    return df


def fit_fallback(raw_profile: dict) -> Stage:
    """Scoring-time fallback: numeric -> training median, text -> first sorted category,
    unknown columns -> 0.0 / "Missing"."""
    fills = {c: s["median"] for c, s in raw_profile["numeric"].items()}
    fills.update({c: s["first"] for c, s in raw_profile["categorical"].items() if s.get("first") is not None})
    return Stage("fallback", {"fills": fills})


@register("fallback")
def _apply_fallback(df, p):
    out = []
    skip = p.get("skip_prefix")
    for f in df.schema.fields:
        c = f.name
        if skip and c.startswith(skip):
            out.append(F.col(c))
        elif c in p["fills"]:
            v = p["fills"][c]
            if role_of(f.dataType) == NUMERIC:
                out.append(F.when(missing(df, c), F.lit(float(v))).otherwise(F.col(c).cast("double")).alias(c))
            else:
                out.append(F.coalesce(F.col(c).cast("string"), F.lit(str(v))).alias(c))
        elif role_of(f.dataType) == NUMERIC:
            out.append(F.when(missing(df, c), F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(F.col(c), F.lit("Missing")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
