"""Multi-feature iterative imputation (chained equations) on Spark.

Missing cells start at the column mean; each round regresses every incomplete column on the
others (``pyspark.ml`` ``LinearRegression``, normal equations: one distributed pass) over the
rows where it was observed, and replaces only its missing cells by the prediction. Every fitted
step is kept as plain coefficients and applied as a column expression, so the fitted table
and the replay on new rows run the same projection chain (no shuffle, nothing to checkpoint).
Stops when the largest change of an imputed cell is below ``tol`` times the largest |value|.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import missing
from ..plans.stage import Stage, register


def _chain(df: DataFrame, p: dict, keep_masks: bool = False) -> DataFrame:
    cols = [c for c in p["columns"] if c in df.columns]
    masks = {c: missing(df, c) for c in cols}
    out = df.select(*[F.col(c) for c in df.columns if c not in cols],
                    *[F.when(masks[c], F.lit(float(p["init"][c]))).otherwise(F.col(c).cast("double")).alias(c)
                      for c in cols],
                    *[masks[c].alias(f"__m_{c}") for c in cols])
    for c, coefs, b in p["steps"]:
        pred = F.lit(float(b))
        for o, w in coefs.items():
            pred = pred + F.col(o) * F.lit(float(w))
        out = out.withColumn(c, F.when(F.col(f"__m_{c}"), pred).otherwise(F.col(c)))
    if keep_masks:
        return out
    return out.drop(*[f"__m_{c}" for c in cols]).select(*df.columns)


@register("mice")
def _apply_mice(df, p):
    return _chain(df, p)


def fit_mice(df: DataFrame, cols: list[str], max_iter: int = 10, tol: float = 1e-3) -> Stage:
    cols = list(cols)
    r = df.agg(*[F.avg(F.when(~missing(df, c), F.col(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.max(F.abs(F.col(c).cast("double"))).alias(f"x{i}") for i, c in enumerate(cols)]).collect()[0]
    params = {"columns": cols, "init": {c: r[f"a{i}"] or 0.0 for i, c in enumerate(cols)}, "steps": []}
    todo = [c for i, c in enumerate(cols) if r[f"m{i}"] > 0]
    norm = max((r[f"x{i}"] or 0.0) for i in range(len(cols))) or 1.0
    base = df.select(*cols)
    if len(cols) < 2 or not todo:
        return Stage("mice", params)
    for _ in range(max_iter):
        before = dict(params, steps=list(params["steps"]))
        for c in todo:
            cur = _chain(base, params, keep_masks=True)
            others = [o for o in cols if o != c]
            train = VectorAssembler(inputCols=others, outputCol="__x").transform(cur.where(~F.col(f"__m_{c}")))
            m = LinearRegression(featuresCol="__x", labelCol=c, solver="normal", regParam=0.0).fit(train)
            params["steps"].append([c, dict(zip(others, map(float, m.coefficients.toArray()))), float(m.intercept)])
        # one pass: the old chain, its values kept, then this round's steps on top
        cur = _chain(base, before, keep_masks=True).select("*", *[F.col(c).alias(f"__o_{c}") for c in todo])
        for c, coefs, b in params["steps"][len(before["steps"]):]:
            pred = F.lit(float(b))
            for o, w in coefs.items():
                pred = pred + F.col(o) * F.lit(float(w))
            cur = cur.withColumn(c, F.when(F.col(f"__m_{c}"), pred).otherwise(F.col(c)))
        deltas = [F.when(F.col(f"__m_{c}"), F.abs(F.col(c) - F.col(f"__o_{c}"))).otherwise(F.lit(0.0)) for c in todo]
        change = cur.agg(*[F.max(d).alias(f"d{i}") for i, d in enumerate(deltas)]).collect()[0]
        change = max((v or 0.0) for v in change)
        if change < tol * norm:
            break
    return Stage("mice", params)
