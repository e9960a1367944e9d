"""Gaussian naive Bayes as one grouped aggregate (fit) and column expressions (predict).

Fit: per-class count, mean and population variance of every feature in one
``groupBy(label)`` with map-side partial aggregation; variance smoothing adds
``var_smoothing * max_j var(x_j)`` where the overall variance comes from the same per-class
numbers (law of total variance), so fitting is a single job whatever the data size.
Predict: joint log-likelihood per class as SQL arithmetic, softmax for probabilities,
first maximum wins. Nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GaussianNB:
    def __init__(self, var_smoothing: float = 1e-9):
        self.var_smoothing = var_smoothing
        self.features: list[str] = []
        self.classes: list = []
        self.prior: list[float] = []
        self.theta: list[list[float]] = []
        self.var: list[list[float]] = []

    def fit(self, df: DataFrame, features: list[str], target: str) -> "GaussianNB":
        self.features = list(features)
        x = [F.col(c).cast("double") for c in features]
        rows = (df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("y"))
                .agg(F.count(F.lit(1)).alias("n"),
                     *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)],
                     *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(x)])
                .collect())
        rows = sorted(rows, key=lambda r: r["y"])
        if not rows:
            raise ValueError("no labelled rows to fit on")
        d = len(features)
        n_tot = sum(r["n"] for r in rows)
        gmean = [sum(r["n"] * r[f"m{i}"] for r in rows) / n_tot for i in range(d)]
        gvar = [sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - gmean[i]) ** 2) for r in rows) / n_tot for i in range(d)]
        eps = self.var_smoothing * (max(gvar) if gvar else 0.0)
        self.classes = [r["y"] for r in rows]
        self.prior = [r["n"] / n_tot for r in rows]
        self.theta = [[r[f"m{i}"] for i in range(d)] for r in rows]
        self.var = [[r[f"v{i}"] + eps for i in range(d)] for r in rows]
        return self

    def state(self) -> dict:
        """The fitted numbers, to be saved as JSON."""
        return dict(vars(self))

    @staticmethod
    def from_state(state: dict) -> "GaussianNB":
        model = GaussianNB()
        vars(model).update(state)
        return model

    def joint_log_likelihood(self):
        out = []
        for k in range(len(self.classes)):
            const = math.log(self.prior[k]) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in self.var[k])
            e = F.lit(const)
            for i, c in enumerate(self.features):
                e = e - (F.col(c).cast("double") - F.lit(self.theta[k][i])) ** 2 / F.lit(2.0 * self.var[k][i])
            out.append(e)
        return out

    def transform(self, df: DataFrame, prediction: str = "prediction", probability: str = "probability",
                  confidence: str = "confidence", index: str = "prediction_index") -> DataFrame:
        jll = F.array(*self.joint_log_likelihood())
        mx = F.array_max(F.col("__jll"))
        probs = F.transform(F.col("__jll"), lambda v: F.exp(v - F.col("__lse")))
        classes = F.array(*[F.lit(c) for c in self.classes])
        out = (df.withColumn("__jll", jll)
               .withColumn("__lse", mx + F.log(F.aggregate(F.col("__jll"), F.lit(0.0), lambda acc, v: acc + F.exp(v - mx))))
               .withColumn(index, (F.array_position(F.col("__jll"), mx) - 1).cast("int"))
               .withColumn(probability, probs)
               .withColumn(prediction, F.element_at(classes, F.col(index) + 1))
               .withColumn(confidence, F.array_max(F.col(probability))))
        return out.drop("__jll", "__lse")

    def params_table(self, spark) -> DataFrame:
        rows = []
        for k, c in enumerate(self.classes):
            for i, f in enumerate(self.features):
                rows.append((str(c), f, float(self.prior[k]), float(self.theta[k][i]), float(self.var[k][i])))
        return spark.createDataFrame(rows, "class string, feature string, prior double, mean double, var double")
