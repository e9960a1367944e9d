"""Categorical encoders: one-hot (flat 0/1 columns), label, ordinal, frequency.

One-hot keeps at most ``cap`` values by construction, so they are literals. The dictionaries of label,
ordinal and frequency are tables at every size (``functions.dictionary``), written where the stage was
fitted and saved with the pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dictionary
from ..functions.distinct import distinct_counts
from ..functions.roles import present
from ..plans.stage import Stage, register


def encode_recommend(df: DataFrame, cols: list[str]) -> DataFrame:
    """<= 2 distinct -> label, <= 10 -> one_hot, else frequency (non-null distinct counts)."""
    return distinct_counts(df, cols).withColumn("method", F.when(F.col("n_distinct") <= 2, "label")
                                                .when(F.col("n_distinct") <= 10, "one_hot").otherwise("frequency"))


# ---------------------------------------------------------------- one-hot

def fit_one_hot(df: DataFrame, cols: list[str], cap: int = 30, keep: int = 29) -> Stage:
    """Dummy columns ``<col>_<category>`` (int 0/1) in sorted category order, source dropped.

    Up to ``cap`` non-null categories: one dummy each, plus ``<col>_nan`` when the fitted
    data holds NULLs. Above ``cap``: the ``keep`` most frequent (ties by smallest value) and
    ``<col>_Other`` for every other value, NULL and unseen included. Only <= cap + 1 values
    per column reach the driver.
    """
    cols = present(df, cols)
    enc = {}
    for c in cols:
        vc = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        # one job: the NULL group (if any) first, then the cap + 1 most frequent values
        got = vc.orderBy(F.col("v").isNull().desc(), F.desc("n"), "v").limit(cap + 2).collect()
        has_null = bool(got) and got[0]["v"] is None
        top = [r for r in got if r["v"] is not None][: cap + 1]
        if len(top) > cap:
            cats = [r["v"] for r in top[:keep]]
            enc[c] = {"categories": sorted(cats + ["Other"]), "other": True, "null_dummy": False}
        else:
            enc[c] = {"categories": sorted(r["v"] for r in top), "other": False, "null_dummy": has_null}
            if has_null:
                enc[c]["categories"] = sorted(enc[c]["categories"] + ["nan"])
    return Stage("one_hot", {"encoders": enc})


@register("one_hot")
def _apply_one_hot(df, p):
    encs = {c: e for c, e in p["encoders"].items() if c in df.columns}
    keep = [F.col(c) for c in df.columns if c not in encs]
    new = []
    for c, e in encs.items():
        x = F.col(c).cast("string")
        for k in e["categories"]:
            if e["other"] and k == "Other":
                real = [v for v in e["categories"] if v != "Other"]
                expr = F.when(x.isNull() | ~x.isin(real), 1).otherwise(0)
            elif e["null_dummy"] and k == "nan":
                expr = F.when(x.isNull(), 1).otherwise(0)
            else:
                expr = F.when(x == F.lit(k), 1).otherwise(0)
            new.append(expr.cast("int").alias(f"{c}_{k}"))
    return df.select(*keep, *new)


# ------------------------------------------------------- label / ordinal

def fit_index(df: DataFrame, cols: list[str], kind: str = "label") -> Stage:
    """Sorted-category index (code-point order). NULL is encoded as the category "Missing".
    label -> int, ordinal -> double; unseen categories -> -1."""
    cols = present(df, cols)
    return Stage(kind, {"columns": cols, **dictionary.save(dictionary.ranked(dictionary.pairs_of(df, cols, "Missing")))})


@register("label")
def _apply_label(df, p):
    return dictionary.look_up(df, p, p["columns"], "Missing", -1.0, "int")


@register("ordinal")
def _apply_ordinal(df, p):
    return dictionary.look_up(df, p, p["columns"], "Missing", -1.0, "double")


# -------------------------------------------------------------- frequency

def fit_frequency(df: DataFrame, cols: list[str]) -> Stage:
    """Share of each category among non-null values; NULL and unseen -> 0.0."""
    cols = present(df, cols)
    totals = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    total = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(float(totals[f"n{i}"] or 1)))])
    table = dictionary.pairs_of(df, cols, None).select("column", "value", (F.col("n") / total[F.col("column")]).alias("code"))
    return Stage("frequency", {"columns": cols, **dictionary.save(table)})


@register("frequency")
def _apply_frequency(df, p):
    return dictionary.look_up(df, p, p["columns"], None, 0.0, "double")


def category_index(df: DataFrame, col: str) -> DataFrame:
    """(category, index) by sorted category, NULL as "Missing"."""
    table = dictionary.ranked(dictionary.pairs_of(df, [col], "Missing"))
    return table.select(F.col("value").alias("category"), F.col("code").cast("int").alias("index"))
