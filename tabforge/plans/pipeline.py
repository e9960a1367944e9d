"""The replayable preparation pipeline and batch scoring.

Stages are kept in the order they were fitted and replayed in that order; each ``apply``
adds column expressions only, so Catalyst collapses the whole replay into a few projections
over the scan. Scoring = validate -> replay -> align -> model -> decode, one lazy plan.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import NUMERIC, role_of
from ..operators.impute import fit_fallback
from ..operators.profile import raw_profile
from .stage import Stage


#: Stages that leave present values as they are; the fallback fill comes after a run of them.
KEEPS_VALUES = ("drop", "impute", "impute_multi", "mice")


class Pipeline:
    def __init__(self):
        self.raw: dict = {}
        self.target: str | None = None
        self.problem_type: str = "Classification"
        self.stages: list[Stage] = []
        self.dropped: list[str] = []
        self.features: list[str] = []
        self.log: list[dict] = []

    # ---- recording
    def init_from_raw(self, raw_df: DataFrame, target: str | None = None, problem_type: str = "Classification"):
        self.raw = raw_profile(raw_df)
        self.target = target
        self.problem_type = problem_type
        return self

    def append(self, stage: Stage, note: str = "") -> "Pipeline":
        if stage.kind == "drop":
            self.dropped += [c for c in stage.params["columns"] if c not in self.dropped]
        self.stages.append(stage)
        self.log.append({"seq": len(self.log) + 1, "stage": stage.kind, "entry": note or stage.kind})
        return self

    def fit_step(self, df: DataFrame, stage: Stage, note: str = "") -> DataFrame:
        self.append(stage, note)
        return stage.apply(df)

    def set_features(self, features: list[str]):
        self.features = list(features)
        return self

    # ---- schema checks
    def required_raw_features(self) -> list[str]:
        cols = self.raw.get("columns", [])
        req = [c for c in cols if c != self.target and c not in self.dropped]
        return req or list(self.features)

    def validate_raw_input(self, raw_df: DataFrame, require_target: bool = False) -> DataFrame:
        """(level, column, message): empty table, missing features, missing target, extra columns
        (warning), numeric columns whose text never parses as a number."""
        spark = raw_df.sparkSession
        issues = []
        req = self.required_raw_features()
        cols = set(raw_df.columns)
        for c in req:
            if c not in cols:
                issues.append(("error", c, "missing required feature column"))
        if require_target and self.target and self.target not in cols:
            issues.append(("error", self.target, "target column is missing"))
        known = set(self.raw.get("columns", [])) | set(req) | {self.target}
        for c in raw_df.columns:
            if c not in known:
                issues.append(("warning", c, "extra column ignored"))
        text_num = [c for c in req if c in cols and c in self.raw.get("numeric", {})
                    and role_of(raw_df.schema[c].dataType) != NUMERIC]
        if raw_df.isEmpty():
            issues.insert(0, ("error", None, "input dataset is empty"))
        elif text_num:  # one aggregate, only where a numeric feature comes as another type
            r = raw_df.agg(*[F.count(F.expr(f"try_cast(`{c}` as double)")).alias(f"p{i}") for i, c in enumerate(text_num)]).first()
            issues += [("error", c, "expects numerical values") for i, c in enumerate(text_num) if r[f"p{i}"] == 0]
        return spark.createDataFrame(issues, "level string, column string, message string")

    # ---- replay
    def transform(self, raw_df: DataFrame, align: bool = True, keep: list[str] | None = None) -> DataFrame:
        """Replay every stage on raw rows without refitting, with the fallback fill on raw values,
        right before the first stage that changes present values; then align to the model features (absent feature -> 0.0).
        ``keep`` columns (e.g. a key or the target) are carried through untouched."""
        keep = [c for c in (keep or []) if c in raw_df.columns]
        df = raw_df
        carried = None
        if keep:
            df = df.select(*[F.col(c) for c in df.columns],
                           *[F.col(c).alias(f"__keep_{c}") for c in keep])
            carried = keep
        fallback_done = False
        for st in self.stages:
            if st.kind not in KEEPS_VALUES and not fallback_done and self.raw:
                df = self._fallback(df)
                fallback_done = True
            df = st.apply(df)
        if not fallback_done and self.raw:
            df = self._fallback(df)
        if align and self.features:
            df = align_features(df, self.features, extra=[f"__keep_{c}" for c in (carried or [])])
        if carried:
            df = df.select(*[F.col(c) for c in df.columns if not c.startswith("__keep_")],
                           *[F.col(f"__keep_{c}").alias(c) for c in carried])
        return df

    def _fallback(self, df):
        fb = fit_fallback(self.raw)
        return Stage("fallback", {"fills": fb.params["fills"], "skip_prefix": "__keep_"}).apply(df)

    def to_json(self) -> str:
        return json.dumps({"raw": self.raw, "target": self.target, "problem_type": self.problem_type,
                           "stages": [json.loads(s.to_json()) for s in self.stages], "dropped": self.dropped,
                           "features": self.features, "log": self.log}, default=float)

    @staticmethod
    def from_json(text: str) -> "Pipeline":
        d = json.loads(text)
        p = Pipeline()
        p.raw, p.target, p.problem_type = d["raw"], d["target"], d["problem_type"]
        p.stages = [Stage(s["kind"], s["params"]) for s in d["stages"]]
        p.dropped, p.features, p.log = d["dropped"], d["features"], d["log"]
        return p

    def log_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(e["seq"], e["stage"], e["entry"]) for e in self.log],
                                     "seq int, stage string, entry string")


def align_features(df: DataFrame, features: list[str], extra: list[str] | None = None) -> DataFrame:
    """Exact feature order; a feature the table lacks becomes 0.0."""
    cols = set(df.columns)
    return df.select(*[F.col(f) if f in cols else F.lit(0.0).alias(f) for f in features], *(extra or []))


def decode_predictions(df: DataFrame, index_col: str, classes: list, out: str) -> DataFrame:
    """Class index -> class value (only from label indices; never reinterprets values)."""
    arr = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.element_at(arr, F.col(index_col).cast("int") + 1))


def score_batch(pipeline: Pipeline, model, raw_df: DataFrame, keep: list[str] | None = None, keep_raw: bool = False) -> DataFrame:
    """raw rows -> replayed features -> model -> ``Predicted_<target>``, ``Confidence`` and, when the
    target is present, ``Accurate`` (classification) or ``Absolute Error`` (regression), after the raw
    columns, or only those of ``keep``. Input that ``validate_raw_input`` finds an error in is refused."""
    target = pipeline.target
    if pipeline.raw:
        errors = [r for r in pipeline.validate_raw_input(raw_df).collect() if r["level"] == "error"]
        if errors:
            raise ValueError("; ".join(f"{r['column']}: {r['message']}" if r["column"] else r["message"] for r in errors))
    keep = list(raw_df.columns if keep_raw or keep is None else keep)
    has_target = target is not None and target in raw_df.columns
    carry = keep + ([target] if has_target and target not in keep else [])
    # under other names, as a raw column may be a feature too
    held = {c: f"__keep_raw_{c}" for c in carry}
    feats = pipeline.transform(raw_df.select("*", *[F.col(c).alias(h) for c, h in held.items()]), keep=list(held.values()))
    scored = model.transform(feats)
    pred_name = f"Predicted_{target}"
    out = scored.withColumnRenamed("prediction", pred_name)
    cols = [F.col(h).alias(c) for c, h in held.items()] + [F.col(pred_name)]
    if "confidence" in out.columns:
        cols.append(F.col("confidence").alias("Confidence"))
    if has_target:
        if pipeline.problem_type == "Classification":
            cols.append((F.col(held[target]).cast("string") == F.col(pred_name).cast("string")).alias("Accurate"))
        else:
            cols.append(F.abs(F.col(held[target]).cast("double") - F.col(pred_name).cast("double")).alias("Absolute Error"))
    return out.select(*cols)


def score_batch_metrics(scored: DataFrame, target: str, problem_type: str = "Classification") -> DataFrame:
    from ..operators.evaluate import metrics_classification
    pred = f"Predicted_{target}"
    if problem_type == "Classification":
        return metrics_classification(scored, target, pred)
    e = F.col(target).cast("double") - F.col(pred).cast("double")
    a = scored.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
                   F.var_pop(F.col(target).cast("double")).alias("vy"), F.count(F.lit(1)).cast("long").alias("n"))
    r2 = F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("vy") * F.col("n"))).otherwise(F.lit(0.0))
    return a.select(r2.alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "n")
