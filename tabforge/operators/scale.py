"""Scalers: one fused aggregate to fit, one projection to apply (flat columns, no vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import number
from ..functions.order_stats import quantiles
from ..functions.roles import NUMERIC, present, role_of
from ..plans.stage import Stage, register


def _numeric(df, cols):
    return [c for c in present(df, cols) if role_of(df.schema[c].dataType) == NUMERIC]


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "standard", quantile_method: str = "auto") -> Stage:
    """standard ((x - mean) / std, ddof 0), minmax ([0, 1]), robust ((x - median) / IQR),
    maxabs (x / max|x|), normalizer (row / L2 norm of the listed columns, stateless).
    A zero scale becomes 1, so constant columns map to 0. Unknown kinds fall back to standard."""
    cols = _numeric(df, cols)
    kind = kind.lower().replace("-", "")
    if kind not in ("standard", "minmax", "robust", "maxabs", "normalizer"):
        kind = "standard"
    params = {"kind": kind, "columns": cols, "center": {}, "scale": {}}
    if kind == "normalizer" or not cols:
        return Stage("scale", params)
    x = {c: number(c) for c in cols}
    if kind == "standard":
        r = df.agg(*[F.avg(x[c]).alias(f"a{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
        center = {c: r[f"a{i}"] for i, c in enumerate(cols)}
        scale = {c: r[f"s{i}"] for i, c in enumerate(cols)}
    elif kind == "minmax":
        r = df.agg(*[F.min(x[c]).alias(f"a{i}") for i, c in enumerate(cols)],
                   *[F.max(x[c]).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
        center = {c: r[f"a{i}"] for i, c in enumerate(cols)}
        scale = {c: (None if r[f"s{i}"] is None else r[f"s{i}"] - r[f"a{i}"]) for i, c in enumerate(cols)}
    elif kind == "maxabs":
        r = df.agg(*[F.max(F.abs(x[c])).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
        center = {c: 0.0 for c in cols}
        scale = {c: r[f"s{i}"] for i, c in enumerate(cols)}
    else:
        q = quantiles(df, cols, [0.25, 0.5, 0.75], method=quantile_method)
        center = {c: q[(c, (), 0.5)] for c in cols}
        scale = {c: (None if q[(c, (), 0.75)] is None else q[(c, (), 0.75)] - q[(c, (), 0.25)]) for c in cols}
    params["center"] = {c: float(v) if v is not None else 0.0 for c, v in center.items()}
    params["scale"] = {c: (float(v) if v not in (None, 0, 0.0) else 1.0) for c, v in scale.items()}
    return Stage("scale", params)


@register("scale")
def _apply_scale(df, p):
    cols = [c for c in p["columns"] if c in df.columns]
    if p["kind"] == "normalizer":
        norm = F.sqrt(sum((F.col(c).cast("double") ** 2 for c in cols), F.lit(0.0)))
        safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
        return df.select(*[(F.col(c).cast("double") / safe).alias(c) if c in cols else F.col(c) for c in df.columns])
    ce, sc = p["center"], p["scale"]
    return df.select(*[((F.col(c).cast("double") - F.lit(ce[c])) / F.lit(sc[c])).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def inverse_scale(df: DataFrame, stage: Stage) -> DataFrame:
    p = stage.params
    if p["kind"] == "normalizer":
        raise ValueError("the normalizer has no inverse")
    cols = [c for c in p["columns"] if c in df.columns]
    return df.select(*[(F.col(c) * F.lit(p["scale"][c]) + F.lit(p["center"][c])).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def scale(df: DataFrame, cols: list[str], kind: str = "standard") -> tuple[DataFrame, Stage]:
    st = fit_scaler(df, cols, kind)
    return st.apply(df), st
