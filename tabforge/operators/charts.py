"""The tables behind the charts: each is an aggregate, never a plot."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import number, seeded_hash
from ..functions.gram import moments
from ..functions.order_stats import quantiles
from ..session import written


LARGE_GROUP = 2_000_000  # rows of a group whose quartiles one task may find
BROADCAST_GROUPS = 100_000  # a table of quartiles of so many groups goes to every task
GROUP_BLOCK = 1_000  # larger groups taken at a time


def histogram(df: DataFrame, col: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (the max falls in the last bin): (bin, bin_start, bin_end[, group], count)."""
    r = df.agg(F.min(number(col)).alias("lo"), F.max(number(col)).alias("hi")).collect()[0]
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    x = number(col)
    b = F.least(F.lit(bins - 1), F.floor((x - F.lit(lo)) / F.lit(width)).cast("int")) if hi > lo else F.lit(0)
    keys = [b.alias("bin")] + ([F.col(group)] if group else [])
    out = df.where(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("count"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                      *([group] if group else []), "count")


def _group_quartiles(base: DataFrame, method: str) -> list[tuple[DataFrame, DataFrame]]:
    """``v`` with (g, q1, median, q3) of any number of groups, as pairs of rows and quartiles to be joined by ``g``.
    Groups of up to ``LARGE_GROUP`` rows are an aggregate that stays in Spark; larger ones, a few for each
    billion rows, go in blocks through the order statistics, whose memory does not grow with a group. What is
    known of large groups is broadcast: their rows are never brought together in one task."""
    spark, schema = base.sparkSession, f"g {base.schema['g'].dataType.simpleString()}, q1 double, median double, q3 double"
    sizes, limit = base.groupBy("g").agg(F.count("*").alias("n")), 0 if method == "select" else LARGE_GROUP
    r = sizes.agg(F.count_if(F.col("n") <= limit).alias("few"), F.collect_list(F.when(F.col("n") > limit, F.struct("g"))).alias("many")).first()
    many = [x.g for x in r.many]
    held = spark.createDataFrame([(g,) for g in many], base.select("g").schema).withColumnRenamed("g", "k")
    out = []
    if r.few or not many:
        few = base.join(F.broadcast(held), base.g.eqNullSafe(held.k), "left_anti") if many else base
        p = F.percentile("v", [0.25, 0.5, 0.75])
        out.append((few, few.groupBy("g").agg(p.alias("p")).select("g", *[F.col("p")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])))
    for at in range(0, len(many), GROUP_BLOCK):
        block = spark.createDataFrame([(g,) for g in many[at:at + GROUP_BLOCK]], held.schema)
        rows = base.join(F.broadcast(block), base.g.eqNullSafe(block.k), "left_semi")
        q = quantiles(rows, ["v"], [0.25, 0.5, 0.75], group_cols=["g"], method="select")
        found = [(g, *[q[("v", (g,), x)] for x in (0.25, 0.5, 0.75)]) for g in many[at:at + GROUP_BLOCK]]
        out.append((rows, F.broadcast(spark.createDataFrame(found, schema))))
    return out


def box_stats(df: DataFrame, y: str, by: str | None = None, whisker: float = 1.5,
              quantile_method: str = "auto") -> DataFrame:
    """q1, median, q3 (linear), whiskers at the most extreme points within whisker x IQR, and the
    number of points beyond them, per group of ``by``."""
    base = df.select((F.col(by) if by else F.lit(None).cast("string")).alias("g"), number(y).alias("v")).where(F.col("v").isNotNull())
    if by:
        parts = _group_quartiles(base, quantile_method)
    else:
        q = quantiles(base, ["v"], [0.25, 0.5, 0.75], method=quantile_method)
        parts = [(base, F.broadcast(df.sparkSession.createDataFrame([(None, *[q[("v", (), p)] for p in (0.25, 0.5, 0.75)])],
                                                                    "g string, q1 double, median double, q3 double")))]
    j = reduce(DataFrame.unionByName, [rows.join(q.withColumnRenamed("g", "k"), F.col("g").eqNullSafe(F.col("k"))).drop("k") for rows, q in parts])
    lo_f = F.col("q1") - whisker * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + whisker * (F.col("q3") - F.col("q1"))
    out = j.groupBy("g", "q1", "median", "q3").agg(
        F.min(F.when(F.col("v") >= lo_f, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= hi_f, F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < lo_f) | (F.col("v") > hi_f)).cast("long").alias("n_outliers"))
    return out.withColumnRenamed("g", by or "group")


def box_outliers(df: DataFrame, y: str, box: DataFrame, by: str | None = None) -> DataFrame:
    """The outlier points themselves (every one of them; the caller may sample for display)."""
    key = by or "group"
    b = written(box.select(F.col(key).alias("__g"), "q1", "q3"), "box")  # one row per group
    b = F.broadcast(b) if b.count() <= BROADCAST_GROUPS else b
    base = df.select((F.col(by) if by else F.lit(None).cast("string")).alias("__k"), number(y).alias(y))
    j = base.join(b, base.__k.eqNullSafe(b.__g))
    iqr = F.col("q3") - F.col("q1")
    return j.where((F.col(y) < F.col("q1") - 1.5 * iqr) | (F.col(y) > F.col("q3") + 1.5 * iqr)).select(
        F.col("__k").alias(key), y)


def scatter_sample(df: DataFrame, cols: list[str], key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """The points to plot: all rows, or with ``n`` a deterministic sample (top-n on md5(key|seed))."""
    if n is None:
        return df.select(key, *cols)
    return (df.select(key, *cols).withColumn("__h", seeded_hash([key], seed))
            .orderBy("__h", key).limit(n).drop("__h"))


def ols_trend(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Least-squares line per group: slope, intercept, r2, n."""
    keys = [group] if group else []
    xd, yd = number(x), number(y)
    return df.groupBy(*keys).agg(F.regr_slope(yd, xd).alias("slope"), F.regr_intercept(yd, xd).alias("intercept"),
                                 F.regr_r2(yd, xd).alias("r2"), F.regr_count(yd, xd).cast("long").alias("n"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every ordered pair (pairwise complete), long form, one pass; NULL where a column
    does not vary."""
    if len(cols) < 2:
        raise ValueError("a correlation matrix needs two or more numeric columns")
    r = moments(df, cols).correlation()
    rows = [(a, b, 1.0 if a == b else None if math.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts (NULL excluded) with share of the counted rows."""
    vc = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("count"))
    total = df.where(F.col(col).isNotNull()).count()  # a scalar: no task ever holds all categories
    return vc.select("value", "count", (F.col("count") / F.lit(float(total or 1))).alias("share"))
