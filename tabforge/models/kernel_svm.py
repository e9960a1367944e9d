"""Kernel SVM and SVR through explicit feature maps written as column expressions.

poly: the homogeneous degree-p monomials of (gamma x.y)^p, scaled by sqrt(multinomial
coefficient), so the linear kernel on the map equals the polynomial kernel exactly.
rbf: D random Fourier features sqrt(2/D) cos(w.x + b), w ~ N(0, 2 gamma I), b ~ U(0, 2 pi)
(seeded): an unbiased approximation of exp(-gamma |x - y|^2).
The classifier is ``LinearSVC`` (one-vs-rest above two classes) on the mapped columns, its margins
calibrated to probabilities. The regressor is a linear epsilon-insensitive fit of the standardised
target by quasi-Newton steps on a smoothed loss; each evaluation is one pass over the cached map.
"""

from __future__ import annotations

import itertools
import json
import math
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import classification as C
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sums import minimise, minimise_side_by_side, rows_of, sum_vectors
from ..session import scratch_path, written
from .calibration import fit_calibration, probabilities
from .spark_ml import TABLE_BYTES

#: Coordinates of an rbf map of more bytes than this are not held: the classes are fitted side by side, each pass makes them anew.
STEP_BYTES = 64 << 20
#: Width of the bend between no loss and linear loss, in standard deviations of the target: from coarse to fine.
BENDS = (1e-1, 1e-2, 1e-3)


def gamma_scale(df: DataFrame, features: list[str]) -> float:
    """gamma = 1 / (d * Var(X)) over all feature values (the 'scale' rule)."""
    x = F.explode(F.array(*[F.col(c).cast("double") for c in features]))
    v = df.select(x.alias("v")).agg(F.var_pop("v")).collect()[0][0] or 0.0
    return 1.0 / (len(features) * v) if v > 0 else 1.0


def random_features(d: int, gamma: float, n_components: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Frequencies, phases and the factor of the rbf map."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2.0 * gamma), size=(n_components, d))
    return w, rng.uniform(0, 2 * math.pi, size=n_components), math.sqrt(2.0 / n_components)


def feature_map(features: list[str], kernel: str, gamma: float, degree: int = 3, n_components: int = 200,
                seed: int = 42) -> list:
    """The mapped coordinates as (unaliased) column expressions."""
    x = [F.col(c).cast("double") for c in features]
    d = len(features)
    if kernel == "linear":
        return list(x)
    if kernel == "poly":
        out = []
        for j, combo in enumerate(itertools.combinations_with_replacement(range(d), degree)):
            counts = np.bincount(combo, minlength=d)
            coef = math.factorial(degree) / np.prod([math.factorial(int(k)) for k in counts])
            e = F.lit(math.sqrt(coef) * gamma ** (degree / 2.0))
            for i in combo:
                e = e * x[i]
            out.append(e)
        return out
    if kernel == "rbf":
        w, b, scale = random_features(d, gamma, n_components, seed)
        out = []
        for j in range(n_components):
            arg = F.lit(float(b[j]))
            for i in range(d):
                arg = arg + x[i] * F.lit(float(w[j, i]))
            out.append(F.cos(arg) * scale)
        return out
    raise ValueError(f"unknown kernel {kernel!r}")


def _spread(df: DataFrame) -> DataFrame:
    """Over all cores, if the table has fewer partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def feature_count(kernel: str, d: int, degree: int, n_components: int) -> int:
    """How many coordinates ``feature_map`` gives."""
    return {"linear": d, "poly": math.comb(d + degree - 1, degree)}.get(kernel, n_components)


def one_vs_rest(estimator: C.OneVsRest, data: DataFrame, classes: int) -> C.OneVsRestModel:
    """``estimator.fit(data)`` without the copy of the whole table that it keeps beside the blocks of each class's fit."""
    svc, label = estimator.getClassifier(), estimator.getLabelCol()
    each = [svc.fit(data.withColumn(label, F.when(F.col(label) == float(i), 1.0).otherwise(0.0))) for i in range(classes)]
    return estimator._copyValues(C.OneVsRestModel(models=each))


def hinge_models(rows: DataFrame, features: list[str], label: str, rbf: tuple, svc: C.LinearSVC, classes: int, n: int) -> tuple[list[C.LinearSVCModel], np.ndarray]:
    """``svc``'s objective, the mean hinge loss and the penalty, minimised for each class against the rest (of two for the
    second) on the rbf map of finite ``features``. A pass over the features makes the map of a batch once for all classes
    and all steps tried. Returns the models and their numbers, the offset last."""
    w, b, scale = rbf
    size, targets = len(b) + 1, np.arange(classes) if classes > 2 else np.array([1])
    k, reg = len(targets), svc.getRegParam()

    def blocks(batch):
        """Blocks that stay in a core's cache: the map, its cosines to single precision, and the label."""
        x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)
        y = batch.column(len(features)).to_numpy(zero_copy_only=False)
        for i in range(0, len(x), 1024):
            turns = (x[i:i + 1024] @ w.T + b) / (2 * np.pi)
            turns -= np.rint(turns)
            z = np.ones((len(turns), size))
            z[:, :-1] = np.cos((2 * np.pi * turns).astype(np.float32))
            z[:, :-1] *= scale
            yield z, y[i:i + 1024]

    def along(at, d, steps):
        tries, both = len(steps), np.concatenate([at, d], axis=1)

        def of(batch):
            loss, grad = np.zeros((tries, k)), np.zeros((size, tries * k))
            for z, y in blocks(batch):
                sign = np.where(y[:, None] == targets, 1.0, -1.0)
                m = z @ both
                short = 1.0 - (sign * m[:, :k])[:, None, :] - (sign * m[:, k:])[:, None, :] * steps
                grad += z.T @ np.where(short > 0, -sign[:, None, :], 0.0).reshape(len(y), tries * k)
                loss += np.maximum(short, 0.0).sum(axis=0)
            return np.concatenate([loss.ravel(), grad.ravel()])

        v = sum_vectors(table, of, tries * k * (size + 1)) / n
        values, grads = v[:tries * k].reshape(tries, k), v[tries * k:].reshape(size, tries, k).transpose(1, 0, 2).copy()
        weights = (at + steps[:, None, :] * d)[:, :-1]
        grads[:, :-1] += reg * weights
        return values + reg / 2 * (weights * weights).sum(axis=1), grads

    table = rows.select(*features, label)
    theta, _, _ = minimise_side_by_side(along, np.zeros((size, k)), svc.getMaxIter(), svc.getTol())

    return [_linear_model(rows.sparkSession, svc, theta[:-1, j], theta[-1, j]) for j in range(k)], theta


def rbf_margins(rbf: tuple, theta: np.ndarray):
    """A function of the feature columns: the margins of all classes as an array."""
    w, b, scale = rbf

    @F.arrow_udf("array<double>")
    def margins(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
        if not np.isfinite(x).all():
            raise ValueError("null, NaN or infinity in a feature of the kernel classifier")
        m = [np.cos(x[i:i + 1024] @ w.T + b) * scale @ theta[:-1] + theta[-1] for i in range(0, len(x), 1024)]
        m = np.concatenate([np.zeros((0, theta.shape[1])), *m])
        m = m if m.shape[1] > 1 else np.concatenate([-m, m], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))

    return margins


def _linear_model(spark, svc: C.LinearSVC, coefficients: np.ndarray, intercept: float) -> C.LinearSVCModel:
    """Spark's model with these numbers, from its saved form."""
    path = scratch_path(spark, "svc")
    named = lambda p: {k.name: v for k, v in p.items()}
    head = {"class": "org.apache.spark.ml.classification.LinearSVCModel", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": f"LinearSVC_{uuid.uuid4().hex[:12]}", "paramMap": named(svc._paramMap), "defaultParamMap": named(svc._defaultParamMap)}
    spark.createDataFrame([(Vectors.dense(coefficients), float(intercept))], ["coefficients", "intercept"]).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return C.LinearSVCModel.load(path)


class KernelSVC:
    def __init__(self, kernel: str = "rbf", C_: float = 1.0, degree: int = 3, n_components: int = 200,
                 max_iter: int = 100, seed: int = 42):
        self.kernel, self.C, self.degree, self.D, self.max_iter, self.seed = kernel, C_, degree, n_components, max_iter, seed
        self._margins = None  # of a model fitted side by side

    def _mapped(self, df):
        cols = feature_map(self.features, self.kernel, self.gamma, self.degree, self.D, self.seed)
        names = [f"__k{i}" for i in range(len(cols))]
        mapped = df.select("*", *[c.alias(nm) for c, nm in zip(cols, names)])
        return VectorAssembler(inputCols=names, outputCol="__features").transform(mapped).drop(*names)

    def fit(self, df: DataFrame, features: list[str], target: str) -> "KernelSVC":
        self.features, self.target, self._margins = list(features), target, None
        base = df.where(F.col(target).isNotNull())
        self.gamma = gamma_scale(base, features)
        self.classes = sorted(r[0] for r in base.select(target).distinct().collect())
        m = F.create_map(*[x for i, c in enumerate(self.classes) for x in (F.lit(c), F.lit(float(i)))])
        bad = F.greatest(*[(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("int") for c in features], F.lit(0))
        n, missing = base.agg(F.count(F.lit(1)), F.max(bad)).first()
        if self.kernel == "rbf" and not missing and n * self.D * 8 > STEP_BYTES:
            return self._fit_side_by_side(base, m[F.col(target)], n)
        large = n * feature_count(self.kernel, len(features), self.degree, self.D) * 8 > TABLE_BYTES
        if large:  # what is kept are the features, not the many mapped coordinates, which each fit holds as blocks of its own
            kept = _spread(base.select(*features, m[F.col(target)].alias("__label"))).persist(StorageLevel.DISK_ONLY)
            data = self._mapped(kept).select("__features", "__label")
        else:
            kept = data = _spread(self._mapped(base.withColumn("__label", m[F.col(target)])).select("__features", "__label")).persist(StorageLevel.MEMORY_AND_DISK)
        svc = C.LinearSVC(featuresCol="__features", labelCol="__label", regParam=1.0 / (self.C * n),
                          maxIter=self.max_iter, standardization=False)
        try:
            if len(self.classes) <= 2:
                self.model = svc.fit(data)
            else:
                one = C.OneVsRest(classifier=svc, featuresCol="__features", labelCol="__label")
                self.model = one_vs_rest(one, data, len(self.classes)) if large else one.fit(data)
            margins = self.model.transform(data).select(vector_to_array("rawPrediction").alias("margins"), F.col("__label").alias("label"))
            if large:  # the Newton steps pass over the margins alone
                margins = written(margins, "margins")
            self.calibration = fit_calibration(margins, max(2, len(self.classes)))
        finally:
            kept.unpersist()
        return self

    def _fit_side_by_side(self, base: DataFrame, label, n: int) -> "KernelSVC":
        k, d = len(self.classes), len(self.features)
        svc = C.LinearSVC(featuresCol="__features", labelCol="__label", regParam=1.0 / (self.C * n), maxIter=self.max_iter, standardization=False)
        names = [f"x{i}" for i in range(d)]
        rows = base.select(*[F.col(c).cast("double").alias(x) for c, x in zip(self.features, names)], label.alias("label"))
        large = n * (d + 1) * 8 > TABLE_BYTES
        rows = _spread(rows).persist(StorageLevel.DISK_ONLY if large else StorageLevel.MEMORY_AND_DISK)
        try:
            rbf = random_features(d, self.gamma, self.D, self.seed)
            models, theta = hinge_models(rows, names, "label", rbf, svc, k, n)
            self._margins = rbf_margins(rbf, theta)
            self.model = models[0] if k <= 2 else C.OneVsRest(classifier=svc, featuresCol="__features", labelCol="__label")._copyValues(C.OneVsRestModel(models=models))
            margins = rows.select(self._margins(*names).alias("margins"), "label")
            self.calibration = fit_calibration(written(margins, "margins"), max(2, k))
        finally:
            rows.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cols = df.columns
        classes = F.array(*[F.lit(c) for c in self.classes])
        if self._margins is not None:
            out = df.withColumn("__margins", self._margins(*[F.col(c).cast("double") for c in self.features]))
            idx = (F.array_position("__margins", F.array_max("__margins")) - 1).cast("int")
        else:
            out = self.model.transform(self._mapped(df)).withColumn("__margins", vector_to_array("rawPrediction"))
            idx = F.col("prediction").cast("int")
        out = out.withColumn("probability", probabilities(F.col("__margins"), self.calibration))
        return out.select(*cols, idx.alias("prediction_index"), F.element_at(classes, idx + 1).alias("prediction"), "probability",
                          F.array_max("probability").alias("confidence"))

    def save_parts(self, path: str) -> dict:
        self.model.write().overwrite().save(path)
        return {k: getattr(self, k) for k in ("kernel", "C", "degree", "D", "max_iter", "seed", "features", "target", "gamma", "classes", "calibration")}

    @staticmethod
    def load_parts(path: str, state: dict) -> "KernelSVC":
        m = KernelSVC()
        m.__dict__.update(state)
        m.model = (C.LinearSVCModel if len(m.classes) <= 2 else C.OneVsRestModel).load(path)
        return m


class KernelSVR:
    """Linear epsilon-SVR on the kernel map: minimise 1/2 |w|^2 + C sum max(0, |y - w.z - b| - eps).

    The target is standardised (with C divided by its deviation the objective is the same up to a factor)
    and the corners of the loss are bent over a width that goes from coarse to fine; each is solved by
    quasi-Newton steps until the objective stands still."""

    def __init__(self, kernel: str = "rbf", C_: float = 1.0, epsilon: float = 0.1, degree: int = 3,
                 n_components: int = 200, max_iter: int = 100, tol: float = 1e-6, seed: int = 42):
        self.kernel, self.C, self.eps, self.degree, self.D = kernel, C_, epsilon, degree, n_components
        self.max_iter, self.tol, self.seed = max_iter, tol, seed

    def fit(self, df: DataFrame, features: list[str], target: str) -> "KernelSVR":
        self.features, self.target = list(features), target
        base = df.where(F.col(target).isNotNull())
        self.gamma = gamma_scale(base, features)
        cols = feature_map(features, self.kernel, self.gamma, self.degree, self.D, self.seed)
        k = len(cols)
        z = _spread(base.select(F.col(target).cast("double").alias("__y"), F.array(*cols).alias("__z"))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            r = z.agg(F.avg("__y").alias("m"), F.stddev_pop("__y").alias("s")).first()
            mean, sd = float(r["m"] or 0.0), float(r["s"] or 0.0) or 1.0
            cost, eps = self.C / sd, self.eps / sd

            def objective(bend):
                def at(theta):
                    w, b = theta[:k], theta[k]

                    def of(batch):
                        x = rows_of(batch, "__z")
                        res = (batch.column("__y").to_numpy(zero_copy_only=False) - mean) / sd - x @ w - b
                        over = np.maximum(np.abs(res) - eps, 0.0)
                        loss = np.where(over < bend, over * over / (2 * bend), over - bend / 2).sum()
                        slope = np.sign(res) * np.minimum(over / bend, 1.0)
                        return np.concatenate([[loss], -(slope @ x), [-slope.sum()]])

                    v = sum_vectors(z, of, k + 2)
                    return 0.5 * float(w @ w) + cost * v[0], np.append(w + cost * v[1:k + 1], cost * v[k + 1])
                return at

            theta, self.steps = np.zeros(k + 1), 0
            for bend in BENDS:
                theta, self.objective, n = minimise(objective(bend), theta, self.max_iter, self.tol)
                self.steps += n
            self.w, self.b = (theta[:k] * sd).tolist(), float(theta[k] * sd + mean)
        finally:
            z.unpersist()
        return self

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        cols = feature_map(self.features, self.kernel, self.gamma, self.degree, self.D, self.seed)
        e = F.lit(float(self.b))
        for c, v in zip(cols, self.w):
            e = e + c * F.lit(float(v))
        return df.withColumn(prediction, e)

    def state(self) -> dict:
        return {k: getattr(self, k) for k in ("kernel", "C", "eps", "degree", "D", "max_iter", "tol", "seed", "features", "target", "gamma", "w", "b")}

    @staticmethod
    def from_state(state: dict) -> "KernelSVR":
        m = KernelSVR()
        m.__dict__.update(state)
        return m
