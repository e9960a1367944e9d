"""Outlier bounds (IQR, z-score, winsorize ranks), clipping and removal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import number
from ..functions.order_stats import order_statistics, long_form, group_stats, quantiles
from ..functions.roles import NUMERIC, present, role_of
from ..plans.stage import Stage, register


def _numeric(df, cols):
    return [c for c in present(df, cols) if role_of(df.schema[c].dataType) == NUMERIC]


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = 1.5, quantile_method: str = "auto") -> dict:
    q = quantiles(df, cols, [0.25, 0.75], method=quantile_method)
    out = {}
    for c in cols:
        q1, q3 = q.get((c, (), 0.25)), q.get((c, (), 0.75))
        if q1 is None or q3 is None:
            continue
        iqr = q3 - q1
        out[c] = (q1 - factor * iqr, q3 + factor * iqr)
    return out


def zscore_bounds(df: DataFrame, cols: list[str], factor: float = 3.0) -> dict:
    """mean +- factor * std (ddof 1); columns with zero or undefined std are skipped."""
    r = df.agg(*[F.avg(number(c)).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.stddev_samp(number(c)).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        m, s = r[f"a{i}"], r[f"s{i}"]
        if s is None or s == 0 or math.isnan(s):
            continue
        out[c] = (m - factor * s, m + factor * s)
    return out


def winsor_bounds(df: DataFrame, cols: list[str], lower_pct: float = 0.05, upper_pct: float = 0.05) -> dict:
    """Values at sorted ranks int(lower*n) and n - int(upper*n) - 1 of the non-missing values:
    everything below / above is set to them. Exact, via distributed order statistics."""
    if not cols:
        return {}
    long = long_form(df, cols)
    stats = group_stats(long, ["__c"])
    req, plan = {}, {}
    for (ci,), (n, _mn, _mx) in stats.items():
        lo_r = int(math.floor(lower_pct * n))
        hi_r = n - int(math.floor(upper_pct * n)) - 1
        lo_r, hi_r = min(lo_r, n - 1), max(min(hi_r, n - 1), 0)
        req[(ci,)] = {lo_r, hi_r}
        plan[ci] = (lo_r, hi_r)
    vals = order_statistics(long, ["__c"], req, stats, columns=(df, cols))
    return {cols[ci]: (vals[((ci,), a)], vals[((ci,), b)]) for ci, (a, b) in plan.items()}


def clip_expr(c: str, lo: float, hi: float):
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x.cast("double")), x).otherwise(
        F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x.cast("double"))))


@register("clip")
def _apply_clip(df, p):
    b = {c: v for c, v in p["bounds"].items() if c in df.columns}
    return df.select(*[clip_expr(c, *b[c]).alias(c) if c in b else F.col(c) for c in df.columns])


def outlier_count(df: DataFrame, bounds: dict) -> DataFrame:
    """(column, lower, upper, n_out) in one aggregate."""
    cols = list(bounds)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, lower double, upper double, n_out long")
    aggs = [F.count_if((number(c) < F.lit(bounds[c][0])) | (number(c) > F.lit(bounds[c][1]))).alias(f"n{i}")
            for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column"), F.lit(float(bounds[c][0])).alias("lower"),
                        F.lit(float(bounds[c][1])).alias("upper"), F.col(f"n{i}").cast("long").alias("n_out"))
               for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def fit_outliers(df: DataFrame, cols: list[str], method: str = "iqr", factor: float | None = None,
                 lower_pct: float = 0.05, upper_pct: float = 0.05, quantile_method: str = "auto") -> Stage:
    """Fit clip bounds for ``method`` in {iqr, zscore, winsorize} on all columns at once."""
    cols = _numeric(df, cols)
    method = method.lower()
    if method == "iqr":
        bounds = iqr_bounds(df, cols, 1.5 if factor is None else factor, quantile_method)
    elif method == "zscore":
        bounds = zscore_bounds(df, cols, 3.0 if factor is None else factor)
    elif method == "winsorize":
        bounds = winsor_bounds(df, cols, lower_pct, upper_pct)
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return Stage("clip", {"method": method, "bounds": {c: [float(a), float(b)] for c, (a, b) in bounds.items()}})


def clip_outliers(df: DataFrame, cols: list[str], method: str = "iqr", **kw) -> tuple[DataFrame, Stage, DataFrame]:
    """Returns (clipped table, stage, per-column counts of values outside the bounds)."""
    st = fit_outliers(df, cols, method, **kw)
    bounds = {c: tuple(v) for c, v in st.params["bounds"].items()}
    return st.apply(df), st, outlier_count(df, bounds)


def remove_outliers(df: DataFrame, cols: list[str], method: str = "iqr", factor: float | None = None,
                    mode: str = "sequential", quantile_method: str = "auto") -> tuple[DataFrame, dict]:
    """Drop rows outside the bounds; missing values are kept.

    sequential: column by column, each column's bounds fitted on the rows left by the
    previous ones (the reference behaviour). joint: all bounds on the input, one filter.
    """
    cols = _numeric(df, cols)
    method = method.lower()
    f = (1.5 if method == "iqr" else 3.0) if factor is None else factor

    def bounds_for(d, cs):
        return iqr_bounds(d, cs, f, quantile_method) if method == "iqr" else zscore_bounds(d, cs, f)

    def keep(c, lo, hi):
        x = F.col(c)
        return x.isNull() | F.isnan(x.cast("double")) | ((x >= F.lit(lo)) & (x <= F.lit(hi)))

    if mode == "joint":
        b = bounds_for(df, cols)
        cond = F.lit(True)
        for c, (lo, hi) in b.items():
            cond = cond & keep(c, lo, hi)
        return df.where(cond), b
    out, all_b = df, {}
    for c in cols:
        b = bounds_for(out, [c])
        if c in b:
            all_b[c] = b[c]
            out = out.where(keep(c, *b[c]))
    return out, all_b
