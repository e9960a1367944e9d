"""Recursive feature elimination on ``pyspark.ml`` linear models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rfe_select(df: DataFrame, features: list[str], target: str, n_features: int = 5,
               problem_type: str = "Classification", max_iter: int = 1500) -> list[str]:
    """Drop the weakest feature (smallest sum of squared coefficients over classes) per round
    until ``n_features`` remain (clamped to 1..d). The assembled table is cached once; each round
    refits on a slice of it."""
    n_features = max(1, min(n_features, len(features)))
    data = df.where(F.col(target).isNotNull())
    if problem_type == "Classification":
        classes = sorted(r[0] for r in data.select(target).distinct().collect())
        m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
        data = data.withColumn("__label", m[F.col(target)])
    else:
        data = data.withColumn("__label", F.col(target).cast("double"))
    data = data.select("__label", *features).cache()
    kept = list(features)
    while len(kept) > n_features:
        vec = VectorAssembler(inputCols=kept, outputCol="__f").transform(data)
        if problem_type == "Classification":
            model = LogisticRegression(featuresCol="__f", labelCol="__label", maxIter=max_iter,
                                       regParam=1.0 / max(1, data.count()), standardization=False).fit(vec)
            mat = model.coefficientMatrix.toArray()
            weight = (mat ** 2).sum(axis=0)
        else:
            model = LinearRegression(featuresCol="__f", labelCol="__label", solver="normal").fit(vec)
            weight = model.coefficients.toArray() ** 2
        kept.pop(int(weight.argmin()))
    data.unpersist()
    return kept
