"""k-nearest-neighbour classifier and regressor on the exact neighbour search.

The fitted model is the training table itself, written as (id, features, target). A classifier
predicts the most frequent class of the neighbours (ties: the smallest class), a regressor their
mean; neighbours at equal distance are taken in the order of their ids. Rows with a missing feature
get no prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbors import nearest
from ..session import written

#: Classes a classifier may have; their shares are one array in each row.
MAX_CLASSES = 10_000


class NeighborModel:
    """``kind``: clf_knn or reg_knn; ``params``: n_neighbors (5)."""

    def __init__(self, kind: str, params: dict | None = None):
        if kind not in ("clf_knn", "reg_knn"):
            raise ValueError(f"unknown model kind {kind!r}")
        self.kind, self.params = kind, dict(params or {})
        self.features: list[str] = []
        self.target: str | None = None
        self.classes: list = []
        self.table: DataFrame | None = None

    @property
    def is_classifier(self) -> bool:
        return self.kind == "clf_knn"

    def fit(self, df: DataFrame, features: list[str], target: str, key: str | None = None) -> "NeighborModel":
        """``key``: a unique column, whose order decides ties; without one the rows are numbered."""
        self.features, self.target = list(features), target
        point = F.col(key) if key else F.monotonically_increasing_id()
        y = F.col(target) if self.is_classifier else F.col(target).cast("double")
        rows = df.where(F.col(target).isNotNull()).select(point.alias("__id"), *[F.col(c).cast("double").alias(c) for c in features], y.alias("__y"))
        self.table = written(rows, "knn-model")
        if self.is_classifier:
            found = self.table.select("__y").distinct().limit(MAX_CLASSES + 1).collect()
            if len(found) > MAX_CLASSES:
                raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes")
            self.classes = sorted(r[0] for r in found)
        return self

    def transform(self, df: DataFrame, prediction: str = "prediction", key: str | None = None) -> DataFrame:
        """``df`` with ``prediction`` and, of a classifier, ``prediction_index``, ``probability`` (the share
        of each class) and ``confidence``. ``key``: a unique column of ``df``; without one a numbered copy is written."""
        rows = df if key else written(df.withColumn("__row", F.monotonically_increasing_id()), "knn-rows")
        row = key or "__row"
        k = int(self.params.get("n_neighbors", 5))
        found = nearest(rows.select(*dict.fromkeys([row, *self.features])), self.table, self.features, k, row, "__id", "__y")
        ys = F.transform("neighbors", lambda s: s["value"])
        if self.is_classifier:
            classes = F.array(*[F.lit(c) for c in self.classes])
            found = found.withColumn("ys", ys)
            found = found.withColumn("probability", F.transform(classes, lambda c: F.size(F.filter("ys", lambda y: y == c)) / F.size("ys")))
            found = found.withColumn("confidence", F.array_max("probability"))
            found = found.withColumn("prediction_index", (F.array_position("probability", F.col("confidence")) - 1).cast("int"))
            extra = [F.col("prediction_index"), F.get(classes, F.col("prediction_index")).alias(prediction), F.col("probability"), F.col("confidence")]
        else:
            mean = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size("neighbors")
            extra = [mean.alias(prediction)]
        found = found.select(F.col("id").alias("__found"), *extra)
        return rows.join(found, rows[row].eqNullSafe(found["__found"]), "left").drop("__found", "__row")

    def save_parts(self, path: str) -> dict:
        self.table.write.mode("overwrite").parquet(path)
        return {"kind": self.kind, "params": self.params, "features": self.features, "target": self.target, "classes": self.classes}

    @staticmethod
    def load_parts(path: str, state: dict) -> "NeighborModel":
        m = NeighborModel(state["kind"], state["params"])
        m.features, m.target, m.classes = state["features"], state["target"], state["classes"]
        m.table = SparkSession.getActiveSession().read.parquet(path)
        return m
