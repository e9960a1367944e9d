"""The audit report as a table (section, key, value); Markdown is only a last formatting step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import profile_table

_KEYS = ["rows", "cols", "missing_count", "duplicate_count", "health_score"]


def audit_table(before: DataFrame, after: DataFrame, pipeline, metrics: DataFrame | None = None,
                model: str | None = None, target: str | None = None, places: int = 6) -> DataFrame:
    """(section, key, value): profiles before and after, the preparation log, the model and its
    metrics (rounded to ``places`` before they become text)."""
    spark = before.sparkSession

    def prof(df, section):
        p = profile_table(df)
        return p.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(k).alias("key"),
                                                     F.col(k).cast("string").alias("value")) for k in _KEYS])).alias("e")
                        ).select("e.*")

    parts = [prof(before, "before"), prof(after, "after")]
    log = [("log", f"{e['seq']:03d}", e["entry"]) for e in pipeline.log]
    meta = [("model", "name", model or ""), ("model", "target", target or "")]
    parts.append(spark.createDataFrame(log + meta, "section string, key string, value string"))
    if metrics is not None:
        k = float(10 ** places)
        parts.append(metrics.select(F.explode(F.array(*[
            F.struct(F.lit("metrics").alias("section"), F.lit(c).alias("key"),
                     (F.round(F.col(c).cast("double") * k, 0) / k).cast("string").alias("value"))
            for c in metrics.columns])).alias("e")).select("e.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_markdown(report: DataFrame) -> str:
    """Format a report table as Markdown, section by section in the order of its rows."""
    rows = report.collect()
    lines, current = [], None
    for r in rows:
        if r["section"] != current:
            current = r["section"]
            lines += ["", f"## {current}", "", "| key | value |", "| --- | --- |"]
        lines.append(f"| {r['key']} | {r['value']} |")
    return "\n".join(lines).strip() + "\n"
