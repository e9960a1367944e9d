"""Sources and sinks: CSV in/out (header, inferred or given schema, NaN -> NULL), the metrics
report as JSON, and model + pipeline persistence saved together."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True,
             null_value: str = "", mode: str = "PERMISSIVE") -> DataFrame:
    """CSV with a header row; types inferred unless ``schema`` is given. NaN is normalised to NULL."""
    r = spark.read.option("header", header).option("mode", mode).option("nullValue", null_value)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return nan_to_null(r.csv(path))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return nan_to_null(spark.read.format(fmt).load(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, no index column, UTF-8; one file per partition (no single-task funnel)."""
    out = df.drop("_row_id") if "_row_id" in df.columns else df
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def with_row_id(df: DataFrame) -> DataFrame:
    """Row ids in partition order: one job counts the rows of each partition, and a row's id is
    its place in its partition after the rows of those before. Rows stay in the JVM."""
    part = F.spark_partition_id()
    counts = {r.p: r.n for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(at)
        at += counts.get(p, 0)
    table = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("_row_id", F.get(table, part) + place)


def write_metrics_json(spark: SparkSession, path: str, dataset: str, model: str, problem_type: str, target: str,
                       metrics: DataFrame, log: list, hyperparameters: dict) -> None:
    """One JSON record: dataset, model, problem type, target, metrics (from a one-row metrics
    DataFrame, kept in Spark), the preparation log and the hyperparameters."""
    about = {"dataset": dataset, "model": model, "problem_type": problem_type, "target": target}
    steps = F.from_json(F.lit(json.dumps(log)), "array<struct<seq: int, stage: string, entry: string>>")
    numbers = F.from_json(F.lit(json.dumps({k: str(v) for k, v in hyperparameters.items()})), "map<string, string>")
    rec = metrics.select(*[F.lit(v).alias(k) for k, v in about.items()], F.struct(*metrics.columns).alias("metrics"),
                         steps.alias("log"), numbers.alias("hyperparameters"))
    rec.coalesce(1).write.mode("overwrite").json(path)  # one row


def _saved_tables(spark: SparkSession, pipeline, path: str) -> str:
    """The pipeline as JSON, with the tables of its stages copied under ``path``."""
    meta = json.loads(pipeline.to_json())
    for i, stage in enumerate(meta["stages"]):
        if "table" in stage["params"]:
            to = f"{path}/tables/{i:03d}"
            spark.read.parquet(stage["params"]["table"]).write.mode("overwrite").parquet(to)
            stage["params"]["table"] = to
    return json.dumps(meta, default=float)


def _own_models() -> dict:
    from ..models.kernel_svm import KernelSVC, KernelSVR
    from ..models.knn import NeighborModel
    from ..models.naive_bayes import GaussianNB
    from ..models.spark_ml import ClusterModel
    return {c.__name__: c for c in (ClusterModel, GaussianNB, NeighborModel, KernelSVC, KernelSVR)}


def save_model(model, pipeline, path: str) -> None:
    """Model and pipeline always saved together: ``<path>/model`` (Spark ML persistence or the model's own
    table, for models that have one), ``<path>/tables`` (dictionaries and other tables of stages) and
    ``<path>/meta``: the model's class and numbers and the pipeline, written through Spark."""
    spark = SparkSession.getActiveSession()
    pipe = _saved_tables(spark, pipeline, path)
    if hasattr(model, "save_parts"):  # has Spark ML models or a table of its own
        meta = {"own": type(model).__name__, "state": model.save_parts(f"{path}/model"), "parts": True, "pipeline": pipe}
    elif hasattr(model, "state"):
        meta = {"own": type(model).__name__, "state": model.state(), "pipeline": pipe}
    else:
        model.model.write().overwrite().save(f"{path}/model")
        for i, part in enumerate(model.more):  # of a forest fitted in several parts
            part.write().overwrite().save(f"{path}/more/{i:03d}")
        meta = {"class": type(model.model).__name__, "kind": model.kind, "params": model.params, "features": model.features,
                "target": model.target, "classes": model.classes, "calibration": model.calibration, "more": len(model.more), "pipeline": pipe}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str):
    """(model, pipeline) of ``save_model``; an unknown model class raises."""
    from pyspark.ml import classification, clustering, regression

    from ..models.spark_ml import SparkModel
    from ..plans.pipeline import Pipeline
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
    pipeline = Pipeline.from_json(meta["pipeline"])
    if "own" in meta:
        kind = _own_models()[meta["own"]]
        return (kind.load_parts(f"{path}/model", meta["state"]) if meta.get("parts") else kind.from_state(meta["state"])), pipeline
    m = SparkModel(meta["kind"], meta["params"])
    m.features, m.target, m.classes, m.calibration = meta["features"], meta["target"], meta["classes"], meta.get("calibration")
    name = meta["class"]
    kind = next(getattr(x, name) for x in (classification, regression, clustering) if hasattr(x, name))
    m.model, m.more = kind.load(f"{path}/model"), [kind.load(f"{path}/more/{i:03d}") for i in range(meta.get("more", 0))]
    return m, pipeline
