"""Multi-feature k-nearest-neighbour imputation.

A missing value becomes the mean of the ``k`` nearest rows that have the column. The squared distance of
two rows is summed over the features that both have and scaled by the number of all features over
the number of shared ones; rows without a shared feature are no neighbours; with no neighbour at
all the column's mean is taken.

Rows are grouped by which features they miss. For each pattern of a receiving row and each pattern of
giving rows the shared features are fixed, so an exact neighbour search in them finds the ``k`` nearest
(``neighbors``), and the best ``k`` over the patterns of the givers are those over all rows. There are as
many searches as pairs of patterns that occur, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import number
from ..plans.stage import Stage, register
from ..session import written
from .neighbors import nearest_squared

#: Patterns of missing features in a table, beyond which the searches would be too many.
MAX_PATTERNS = 256


def _pattern(features: list[str]):
    return F.concat(*[F.when(number(c).isNull(), "0").otherwise("1") for c in features])


def _patterns(df: DataFrame, column: str) -> list[str]:
    found = sorted(r[0] for r in df.select(column).distinct().limit(MAX_PATTERNS + 1).collect())
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of missing features")
    return found


def fit_knn_impute(df: DataFrame, features: list[str], n_neighbors: int = 5, key: str | None = None) -> Stage:
    """``key``: a unique column, whose order decides ties in distance; without one the rows are numbered."""
    givers = df.select((F.col(key) if key else F.monotonically_increasing_id()).alias("__id"), *[number(c).alias(c) for c in features])
    givers = written(givers, "knn-givers")
    r = givers.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return Stage("impute_knn", {"table": givers._written_at, "features": list(features), "k": int(n_neighbors),
                                "means": {c: r[f"m{i}"] for i, c in enumerate(features)}})


@register("impute_knn")
def _apply_knn_impute(df: DataFrame, p: dict) -> DataFrame:
    spark, features, k = SparkSession.getActiveSession(), p["features"], p["k"]
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"imputation needs the columns {', '.join(absent)}")
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "knn-rows")
    lacking = rows.select("__row", *[number(c).alias(c) for c in features], _pattern(features).alias("__pattern")).where(F.instr("__pattern", "0") > 0)
    givers = spark.read.parquet(p["table"]).withColumn("__pattern", _pattern(features)).withColumn("__values", F.array(*features))
    found = None
    own, theirs = _patterns(lacking, "__pattern"), _patterns(givers, "__pattern")
    for mine in own:
        for other in theirs:
            shared = [c for c, a, b in zip(features, mine, other) if a == b == "1"]
            gives = [i for i, (a, b) in enumerate(zip(mine, other)) if a == "0" and b == "1"]
            if not shared or not gives:
                continue
            near = nearest_squared(lacking.where(F.col("__pattern") == mine), givers.where(F.col("__pattern") == other), shared, k, "__row", "__id", "__values")
            scale = len(features) / len(shared)
            each = near.select("id", F.explode("found").alias("s")).select("id", (F.lit(scale) * F.col("s.d2")).alias("d"), F.col("s.id").alias("giver"),
                                                                          F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("s.value")[i].alias("v")) for i in gives])).alias("g"))
            each = each.select("id", "d", "giver", "g.i", "g.v")
            found = each if found is None else found.unionByName(each)
    mean = {c: F.lit(m).cast("double") for c, m in p["means"].items()}
    if found is None:
        return rows.select(*[F.coalesce(number(c), mean[c]).alias(c) if c in features else F.col(c) for c in df.columns])
    # at most k rows for each pair of patterns
    best = F.slice(F.sort_array(F.collect_list(F.struct("d", "giver", "v"))), 1, k)
    fills = found.groupBy("id", "i").agg(best.alias("b"))
    fills = fills.select("id", "i", (F.aggregate("b", F.lit(0.0), lambda a, s: a + s["v"]) / F.size("b")).alias("fill"))
    fills = fills.groupBy("id").agg(*[F.max(F.when(F.col("i") == i, F.col("fill"))).alias(f"__fill_{i}") for i in range(len(features))])
    both = rows.join(fills, rows["__row"] == fills["id"], "left")
    at = {c: i for i, c in enumerate(features)}
    return both.select(*[F.coalesce(number(c), F.col(f"__fill_{at[c]}"), mean[c]).alias(c) if c in at else F.col(c) for c in df.columns])
