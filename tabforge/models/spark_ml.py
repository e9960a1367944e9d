"""The model menu on ``pyspark.ml``: distributed fits on an assembled feature vector, built
only at the model boundary. Labels are indexed by sorted class value (literal map over the
bounded class list) and predictions decoded back, so every model has the same output shape:
``prediction`` (class value or number), ``probability`` (array, when the model has one),
``confidence`` (max probability)."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .binned import Cells, bins_of, cells_of, fit_boosted, fit_forest
from .calibration import fit_calibration, probabilities

MAX_TREE_DEPTH = 30  # Spark's tree depth limit; deeper requests are clamped, which param_table reports

#: A forest's fit holds a number for each row and tree; one fit takes as many trees as stay below this (all of them, on smaller tables).
TREE_BYTES = 2 << 30
#: The forest of a classifier is grown from counts (``binned``) on a table of more rows than this, boosted trees always.
FOREST_ROWS = 1 << 17
#: With so many training rows for each combination of bins, the predictions of all combinations are made once and looked up.
ROWS_PER_ANSWER = 8
#: Combinations of bins whose predictions are broadcast.
BROADCAST_ANSWERS = 1 << 18
#: Restarts of k-means at a time.
PARALLEL_FITS = 5
#: A training table of up to so many bytes of numbers is held in memory, a larger one on disk: the learners hold a copy of their own.
TABLE_BYTES = 512 << 20

CLASSIFIERS = {"clf_random_forest", "clf_decision_tree", "clf_logistic", "clf_svm", "clf_mlp", "clf_gbt"}
REGRESSORS = {"reg_random_forest", "reg_decision_tree", "reg_linear", "reg_ridge", "reg_lasso", "reg_gbt"}


def _assemble(df: DataFrame, features: list[str], out: str = "__features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


class SparkModel:
    def __init__(self, kind: str, params: dict | None = None):
        self.kind = kind
        self.params = dict(params or {})
        self.features: list[str] = []
        self.target: str | None = None
        self.classes: list = []
        self.model = None
        self.more: list = []  # further parts of a forest fitted in several, the first being ``model``
        self.answers: tuple | None = None  # the predictions of a model grown from counts by combination of bins, and the cuts
        self.warnings: list[str] = []
        self.calibration: dict | None = None

    @property
    def is_classifier(self):
        return self.kind in CLASSIFIERS

    def _estimator(self, n: int, y_sd: float | None, k: int, trees: int | None = None, seed: int = 42):
        p = self.params
        subset = "auto"  # of a part of a forest it must not depend on the trees of that part
        whole = trees is None
        if not whole:
            subset = "sqrt" if self.is_classifier else "onethird"
        trees = trees or int(p.get("n_estimators", 100))
        fc, lc = "__features", "__label"
        depth = int(p.get("max_depth", 12 if "forest" in self.kind else 10))
        if depth > MAX_TREE_DEPTH:
            self.warnings.append(f"max_depth {depth} clamped to {MAX_TREE_DEPTH}")
            depth = MAX_TREE_DEPTH
        # both children of a split have this many rows, so no node of fewer than min_samples_split rows is split
        least = max(int(p.get("min_samples_leaf", 1)), math.ceil(int(p.get("min_samples_split", 2)) / 2))
        kind = self.kind
        if kind == "clf_random_forest":
            return C.RandomForestClassifier(featuresCol=fc, labelCol=lc, maxMemoryInMB=1024, cacheNodeIds=whole, numTrees=trees, featureSubsetStrategy=subset,
                                            maxDepth=depth, minInstancesPerNode=least, seed=seed)
        if kind == "reg_random_forest":
            return R.RandomForestRegressor(featuresCol=fc, labelCol=lc, maxMemoryInMB=1024, cacheNodeIds=whole, numTrees=trees, featureSubsetStrategy=subset,
                                           maxDepth=depth, minInstancesPerNode=least, seed=seed)
        if kind == "clf_decision_tree":
            return C.DecisionTreeClassifier(featuresCol=fc, labelCol=lc, maxMemoryInMB=1024, cacheNodeIds=True, maxDepth=depth,
                                            minInstancesPerNode=least, seed=42)
        if kind == "reg_decision_tree":
            return R.DecisionTreeRegressor(featuresCol=fc, labelCol=lc, maxMemoryInMB=1024, cacheNodeIds=True, maxDepth=depth,
                                           minInstancesPerNode=least, seed=42)
        if kind == "clf_logistic":
            c = float(p.get("C", 1.0))
            return C.LogisticRegression(featuresCol=fc, labelCol=lc, regParam=1.0 / (c * n), elasticNetParam=0.0,
                                        standardization=False, maxIter=int(p.get("max_iter", 100)), tol=1e-8)
        if kind == "clf_svm":
            c = float(p.get("C", 1.0))
            svc = C.LinearSVC(featuresCol=fc, labelCol=lc, regParam=1.0 / (c * n), maxIter=int(p.get("max_iter", 100)),
                              standardization=False)
            return svc if k <= 2 else C.OneVsRest(classifier=svc, featuresCol=fc, labelCol=lc)
        if kind == "clf_mlp":
            h = int(p.get("hidden", 100))
            return C.MultilayerPerceptronClassifier(featuresCol=fc, labelCol=lc, layers=[len(self.features), h, k],
                                                    maxIter=int(p.get("max_iter", 200)), seed=42)
        if kind == "clf_gbt":
            gbt = C.GBTClassifier(featuresCol=fc, labelCol=lc, maxIter=int(p.get("n_estimators", 100)),
                                  stepSize=float(p.get("learning_rate", 0.1)), maxDepth=int(p.get("max_depth", 6)), seed=42)
            return gbt if k <= 2 else C.OneVsRest(classifier=gbt, featuresCol=fc, labelCol=lc)
        if kind == "reg_gbt":
            return R.GBTRegressor(featuresCol=fc, labelCol=lc, maxIter=int(p.get("n_estimators", 100)),
                                  stepSize=float(p.get("learning_rate", 0.1)), maxDepth=int(p.get("max_depth", 6)), seed=42)
        if kind == "reg_linear":
            return R.LinearRegression(featuresCol=fc, labelCol=lc, regParam=0.0, solver="normal")
        if kind == "reg_ridge":
            alpha = float(p.get("alpha", 1.0))
            return R.LinearRegression(featuresCol=fc, labelCol=lc, regParam=alpha * (y_sd or 1.0) / n,
                                      elasticNetParam=0.0, standardization=False, solver="l-bfgs", maxIter=500, tol=1e-10)
        if kind == "reg_lasso":
            return R.LinearRegression(featuresCol=fc, labelCol=lc, regParam=float(p.get("alpha", 1.0)),
                                      elasticNetParam=1.0, standardization=False, maxIter=500, tol=1e-10)
        raise ValueError(f"unknown model kind {kind!r}")

    def fit(self, df: DataFrame, features: list[str], target: str) -> "SparkModel":
        self.features, self.target = list(features), target
        base = df.where(F.col(target).isNotNull())
        stats = base.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(F.col(target).cast("double")).alias("sd")
                         if not self.is_classifier else F.lit(None).alias("sd")).collect()[0]
        n, sd = stats["n"], stats["sd"]
        if self.is_classifier:
            self.classes = sorted(r[0] for r in base.select(target).distinct().collect())
            label = self._index(F.col(target))
        else:
            label = F.col(target).cast("double")
        cells = self._cells(base, label, n)
        if cells is not None:
            return self._fit_cells(cells, n)
        data = _assemble(base.withColumn("__label", label), self.features).select("__features", "__label")
        par = data.sparkSession.sparkContext.defaultParallelism
        if data.rdd.getNumPartitions() < par:
            data = data.repartition(par)
        # iterative learners make many passes: keep the two-column training table (spills to disk)
        large = n * (len(self.features) + 1) * 8 > TABLE_BYTES
        data = data.persist(StorageLevel.DISK_ONLY if large else StorageLevel.MEMORY_AND_DISK)
        try:
            parts = self._forest_parts(n)
            if len(parts) > 1:
                # a pass sends a histogram of every node from each partition
                narrow = data.coalesce(par)
                self.model, *self.more = [self._estimator(n, sd, len(self.classes), t, 42 + i).fit(narrow) for i, t in enumerate(parts)]
            else:
                self.model, self.more = self._estimator(n, sd, len(self.classes)).fit(data), []
            if self.kind in ("clf_svm", "clf_gbt"):
                out = self.model.transform(data)
                if "probability" not in out.columns:  # margins only: calibrated to probabilities of all classes
                    rows = out.select(vector_to_array("rawPrediction").alias("margins"), F.col("__label").alias("label"))
                    if large:  # the Newton steps pass over the margins alone
                        rows = written(rows, "margins")
                    self.calibration = fit_calibration(rows, max(2, len(self.classes)))
        finally:
            data.unpersist()
        return self

    def _cells(self, base: DataFrame, label, n: int) -> Cells | None:
        """The training table as counts, for the classifiers that are grown from them; None where it does not come to few enough."""
        kinds = {f.name: f.dataType for f in base.schema.fields}
        numbers = all(isinstance(kinds.get(c), (T.NumericType, T.BooleanType)) for c in self.features)
        if not numbers or not (self.kind == "clf_gbt" or self.kind == "clf_random_forest" and n > FOREST_ROWS):
            return None
        names = [f"x{i}" for i in range(len(self.features))]
        rows = base.select(*[F.col(c).cast("double").alias(x) for c, x in zip(self.features, names)], label.alias("label"))
        return cells_of(rows, names, "label", len(self.classes), n)

    def _fit_cells(self, cells: Cells, n: int) -> "SparkModel":
        estimator, k = self._estimator(n, None, len(self.classes)), len(self.classes)
        self.more, self.answers = [], None
        if self.kind == "clf_random_forest":
            self.model = fit_forest(cells, estimator)
        elif k <= 2:
            self.model = fit_boosted(cells, estimator)[0]
        else:
            self.model = estimator._copyValues(C.OneVsRestModel(models=fit_boosted(cells, estimator.getClassifier())))
            margins = self.model.transform(cells.rows()).select(vector_to_array("rawPrediction").alias("margins"), F.explode("__each").alias("each"))
            self.calibration = fit_calibration(written(margins.select("margins", "each.*"), "margins"), k, weight="n")
        if n >= ROWS_PER_ANSWER * math.prod(cells.shape):
            out = self.model.transform(cells.grid())
            self.answers = written(out.select("__bins", *[c for c in ("rawPrediction", "probability", "prediction") if c in out.columns]), "answers"), cells.cuts
        return self

    def _forest_parts(self, n: int) -> list[int]:
        """How many trees of a forest each fit grows."""
        if not self.kind.endswith("random_forest"):
            return [1]
        trees = int(self.params.get("n_estimators", 100))
        fits = math.ceil(trees / max(2, TREE_BYTES // (4 * max(n, 1))))
        return [trees // fits + (i < trees % fits) for i in range(fits)]

    def _votes(self, df: DataFrame) -> DataFrame:
        """What one fit of the whole forest would give, from its parts: the votes of all trees, or their mean."""
        parts, cols = [self.model, *self.more], df.columns
        if not self.is_classifier:
            for i, m in enumerate(parts):
                df = m.copy().setPredictionCol(f"__part{i}").transform(df)
            total = sum((F.col(f"__part{i}") * m.getNumTrees for i, m in enumerate(parts)), F.lit(0.0))
            return df.select(*cols, (total / sum(m.getNumTrees for m in parts)).alias("prediction"))
        for i, m in enumerate(parts):
            df = m.copy().setRawPredictionCol(f"__part{i}").setProbabilityCol("").setPredictionCol("").transform(df)
        votes = [F.zip_with(*[vector_to_array(f"__part{i}") for i in (a, a + 1)], lambda x, y: x + y) if a + 1 < len(parts) else vector_to_array(f"__part{a}")
                 for a in range(0, len(parts), 2)]
        while len(votes) > 1:
            votes = [F.zip_with(votes[a], votes[a + 1], lambda x, y: x + y) if a + 1 < len(votes) else votes[a] for a in range(0, len(votes), 2)]
        df = df.select(*cols, votes[0].alias("__votes"))
        total = F.aggregate("__votes", F.lit(0.0), lambda a, v: a + v)
        return df.select(*cols, array_to_vector(F.transform("__votes", lambda v: v / total)).alias("probability"),
                         (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double").alias("prediction"))

    def _looked_up(self, df: DataFrame) -> DataFrame:
        """What the model predicts for a row: the same as for any other with its bins."""
        found, cuts = self.answers
        small = math.prod(len(c) + 1 for c in cuts) <= BROADCAST_ANSWERS
        return bins_of(df, "__features", cuts).join(F.broadcast(found) if small else found, "__bins").drop("__bins")

    def _index(self, col):
        m = F.create_map(*[x for i, c in enumerate(self.classes) for x in (F.lit(c), F.lit(float(i)))])
        return m[col]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        cols = df.columns
        rows = _assemble(df, self.features)
        out = self._looked_up(rows) if self.answers else self._votes(rows) if self.more else self.model.transform(rows)
        keep = [F.col(c) for c in cols]
        if self.is_classifier:
            classes = F.array(*[F.lit(c) for c in self.classes])
            idx = F.col("prediction").cast("int")
            extra = [idx.alias("prediction_index"), F.element_at(classes, idx + 1).alias(prediction)]
            if self.calibration:
                out = out.withColumn("__margins", vector_to_array("rawPrediction"))
                out = out.withColumn("__prob", probabilities(F.col("__margins"), self.calibration))
            elif "probability" in out.columns:
                out = out.withColumn("__prob", vector_to_array("probability"))
            if "__prob" in out.columns:
                extra += [F.col("__prob").alias("probability"), F.array_max("__prob").alias("confidence")]
            return out.select(*keep, *extra)
        return out.select(*keep, F.col("prediction").alias(prediction))

    @staticmethod
    def _importances(m) -> list[float] | None:
        if hasattr(m, "featureImportances"):
            return list(m.featureImportances.toArray())
        if hasattr(m, "coefficientMatrix"):
            return list(abs(m.coefficientMatrix.toArray()).mean(axis=0))
        if hasattr(m, "coefficients"):
            return [abs(v) for v in m.coefficients.toArray()]
        return None

    def feature_importance(self, spark) -> DataFrame:
        """By feature, largest first: tree importances or absolute coefficients, of several one-vs-rest
        models their mean; NULL for a model that has neither."""
        models = [self.model, *self.more] if self.more else getattr(self.model, "models", [self.model])
        each = [self._importances(m) for m in models]
        weights = [m.getNumTrees if self.more else 1 for m in models]
        imp = [None] * len(self.features) if any(e is None for e in each) else [float(sum(x * w for x, w in zip(v, weights)) / sum(weights)) for v in zip(*each)]
        rows = sorted(zip(self.features, imp), key=lambda t: -(t[1] or 0.0))
        return spark.createDataFrame(rows, "Feature string, Importance double")

    def param_table(self, spark) -> DataFrame:
        est_params = [(p.name, str(v)) for p, v in self.model.extractParamMap().items()] if hasattr(
            self.model, "extractParamMap") else []
        if self.more:
            est_params = [(k, str(int(self.params.get("n_estimators", 100))) if k == "numTrees" else v) for k, v in est_params]
        rows = sorted(est_params + [(f"user.{k}", str(v)) for k, v in self.params.items()]
                      + [(f"warning.{i}", w) for i, w in enumerate(self.warnings, 1)])
        return spark.createDataFrame(rows, "param string, value string")


def fit_kmeans(df: DataFrame, features: list[str], k: int = 3, restarts: int = 10, seed: int = 42):
    """k-means|| for seeds seed..seed+restarts-1 on one cached vector table; lowest cost wins (of equal ones the
    first seed). The restarts run side by side: a step is a short job whose last task the others need not wait for."""
    data = _assemble(df, features).select("__features").cache()

    def one(s):
        m = K.KMeans(featuresCol="__features", predictionCol="Cluster", k=k, seed=s, maxIter=300, tol=1e-6).fit(data)
        return m.summary.trainingCost, m

    with ThreadPoolExecutor(min(restarts, PARALLEL_FITS)) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(one), range(seed, seed + restarts)))
    data.unpersist()
    return min(found, key=lambda f: f[0])[1]


def kmeans_assign(model, df: DataFrame, features: list[str]) -> DataFrame:
    cols = df.columns
    return model.transform(_assemble(df, features)).select(*cols, "Cluster")


class ClusterModel:
    """k-means with its features, so that it can be saved with a pipeline."""

    def __init__(self, k: int = 3, restarts: int = 10, seed: int = 42):
        self.k, self.restarts, self.seed = k, restarts, seed

    def fit(self, df: DataFrame, features: list[str]) -> "ClusterModel":
        self.features = list(features)
        self.model = fit_kmeans(df, features, self.k, self.restarts, self.seed)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return kmeans_assign(self.model, df, self.features)

    def save_parts(self, path: str) -> dict:
        self.model.write().overwrite().save(path)
        return {"k": self.k, "restarts": self.restarts, "seed": self.seed, "features": self.features}

    @staticmethod
    def load_parts(path: str, state: dict) -> "ClusterModel":
        m = ClusterModel(state["k"], state["restarts"], state["seed"])
        m.features, m.model = state["features"], K.KMeansModel.load(path)
        return m
