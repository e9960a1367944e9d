"""Profiling and data-quality reports. Each report is one or two fused aggregate jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distinct import distinct_counts, distinct_up_to
from ..functions.exprs import missing, number, seeded_hash
from ..functions.order_stats import quantiles
from ..functions.roles import CATEGORICAL, NUMERIC, categorical_columns, numeric_columns, roles


def _n_cols_by_role(df: DataFrame):
    r = roles(df)
    return (sum(1 for v in r.values() if v == NUMERIC), sum(1 for v in r.values() if v == CATEGORICAL))


def health_score_expr(rows: Column, cols: int, missing_pct: Column, dup_pct: Column) -> Column:
    """100 - min(35, int(1.5 missing%)) - min(25, int(1.2 dup%)) - 20 if cols < 2, clamped to [10, 100]."""
    score = (F.lit(100)
             - F.when(missing_pct > 0, F.least(F.lit(35), F.floor(missing_pct * 1.5).cast("int"))).otherwise(0)
             - F.when(dup_pct > 0, F.least(F.lit(25), F.floor(dup_pct * 1.2).cast("int"))).otherwise(0)
             - F.lit(20 if cols < 2 else 0))
    return F.when((rows == 0) | F.lit(cols == 0), F.lit(0)).otherwise(
        F.greatest(F.lit(10), F.least(F.lit(100), score))).cast("int")


def _size_expr(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long")
    return F.lit(dt.defaultSize).cast("long")


def profile_table(df: DataFrame, with_memory: bool = False, duplicates: str = "exact",
                  rsd: float = 0.01) -> DataFrame:
    """rows, cols, role counts, missing / duplicate counts and %, health score.

    duplicates="exact" (default): rows are counted by 128 bits of hash, combined before the shuffle, and compared
    whole only where a hash is there twice (``distinct_rows``). duplicates="approx": a single pass with no row shuffle: the distinct-row count
    is a HyperLogLog estimate (relative error ``rsd``) over a 64-bit hash of the whole row; meant
    for a first look at very large tables, reported as an estimate.
    """
    cols = df.columns
    n_num, n_cat = _n_cols_by_role(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [(0, 0, 0, 0, 0, 0.0, 0, 0.0, 0)],
            "rows long, cols int, numeric_count int, categorical_count int, missing_count long, "
            "missing_pct double, duplicate_count long, duplicate_pct double, health_score int")
    miss_row = sum((F.when(missing(df, c), 1).otherwise(0) for c in cols), F.lit(0))
    if duplicates == "approx":
        aggs = [F.count(F.lit(1)).alias("rows"),
                F.least(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*cols), rsd)).alias("distinct_rows"),
                F.sum(miss_row).alias("missing_count")]
        if with_memory:
            aggs.append(F.sum(sum((_size_expr(df, c) for c in cols), F.lit(0))).alias("bytes"))
        p = df.agg(*aggs)
    else:
        aggs = [F.count(F.lit(1)).alias("rows"), F.lit(distinct_rows(df)).alias("distinct_rows"), F.sum(miss_row).alias("missing_count")]
        if with_memory:
            aggs.append(F.sum(sum((_size_expr(df, c) for c in cols), F.lit(0))).alias("bytes"))
        p = df.agg(*aggs)
    rows = F.coalesce(F.col("rows"), F.lit(0)).cast("long")
    miss = F.coalesce(F.col("missing_count"), F.lit(0)).cast("long")
    dup = (rows - F.col("distinct_rows")).cast("long")
    cells = F.greatest(rows * len(cols), F.lit(1))
    missing_pct = miss / cells * 100.0
    dup_pct = F.when(rows > 0, dup / rows * 100.0).otherwise(0.0)
    out = [rows.alias("rows"), F.lit(len(cols)).alias("cols"), F.lit(n_num).alias("numeric_count"),
           F.lit(n_cat).alias("categorical_count"), miss.alias("missing_count"), missing_pct.alias("missing_pct"),
           dup.alias("duplicate_count"), dup_pct.alias("duplicate_pct"),
           health_score_expr(rows, len(cols), missing_pct, dup_pct).alias("health_score")]
    if with_memory:
        out.append((F.coalesce(F.col("bytes"), F.lit(0)) / (1024.0 * 1024.0)).alias("memory_mb"))
    return p.select(*out)


def distinct_rows(df: DataFrame) -> int:
    """How many different rows there are, exactly. Rows go by 128 bits of hash; whole rows are compared only
    where a hash is there twice, so a table without duplicates shuffles 16 bytes a row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = [F.col(c) + F.lit(0.0) if isinstance(t, (T.DoubleType, T.FloatType)) else F.to_json(c) if isinstance(t, (T.MapType, T.VariantType)) else F.col(c)
             for c, t in kinds.items()]  # 0.0 and -0.0 are one value
    hashed = df.withColumns({"__h1": F.xxhash64(*plain), "__h2": F.xxhash64(F.lit(1), *plain)})
    groups = hashed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"))
    r = groups.agg(F.count_if(F.col("__n") == 1).alias("single"), F.count_if(F.col("__n") > 1).alias("several")).first()
    if not r["several"]:
        return r["single"]
    again = groups.where(F.col("__n") > 1).select("__h1", "__h2")
    return r["single"] + hashed.join(again, ["__h1", "__h2"], "left_semi").select(*df.columns).distinct().count()


def health_score(df: DataFrame) -> DataFrame:
    return profile_table(df).select("health_score")


def schema_table(df: DataFrame, order_by: str) -> DataFrame:
    """Per column: dtype, distinct values counting NULL as one, missing count and %, first non-null
    value in ``order_by`` order (as text). One aggregate, and one group-by of (column, value) pairs."""
    cols = df.columns
    distinct = {r.column: r.n_distinct for r in distinct_counts(df, cols).collect()}  # a row for each column
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.count_if(missing(df, c)).alias(f"m{i}"),
            F.count_if(F.col(c).isNull()).alias(f"z{i}"),
            F.min_by(F.col(c).cast("string"), F.when(~missing(df, c), F.col(order_by))).alias(f"s{i}"),
        ]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    wide = df.agg(*aggs)
    entries = []
    for i, c in enumerate(cols):
        entries.append(F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            (F.lit(distinct[c]) + F.when(F.col(f"z{i}") > 0, 1).otherwise(0)).cast("long").alias("n_unique"),
            F.col(f"m{i}").cast("long").alias("missing_count"),
            F.when(F.col("__rows") > 0, F.col(f"m{i}") / F.col("__rows") * 100.0).otherwise(0.0).alias("missing_pct"),
            F.coalesce(F.col(f"s{i}"), F.lit("None")).alias("sample_value"),
            F.lit(i).alias("position")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def head(df: DataFrame, order_by, n: int = 15) -> DataFrame:
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*order_by).limit(n)


def _adjusted_moments(n, g1, g2):
    skew = kurt = None
    if n is not None and g1 is not None and n > 2 and not math.isnan(g1):
        skew = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    if n is not None and g2 is not None and n > 3 and not math.isnan(g2):
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return skew, kurt


def describe_numeric(df: DataFrame, cols: list[str] | None = None, places: int = 3,
                     quantile_method: str = "auto") -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 %, max, sample-adjusted skewness and excess kurtosis."""
    from ..functions.order_stats import BUILTIN_PERCENTILE_BYTES, estimated_bytes
    cols = cols or numeric_columns(df)
    spark = df.sparkSession
    if quantile_method == "auto":
        quantile_method = "builtin" if estimated_bytes(df) <= BUILTIN_PERCENTILE_BYTES else "select"
    probs = [0.25, 0.5, 0.75]
    aggs = []
    for i, c in enumerate(cols):
        x = number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.skewness(x).alias(f"g{i}"),
                 F.kurtosis(x).alias(f"k{i}")]
        if quantile_method == "builtin":  # small input: the quartiles ride in the same aggregate
            aggs.append(F.percentile(x, probs).alias(f"q{i}"))
    r = df.agg(*aggs).collect()[0] if cols else None
    if quantile_method == "builtin":
        q = {(c, (), p): (None if r[f"q{i}"] is None else r[f"q{i}"][j])
             for i, c in enumerate(cols) for j, p in enumerate(probs)}
    else:
        counts = {(c,): (r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols)} if cols else {}
        q = quantiles(df, cols, probs, method=quantile_method, counts=counts) if cols else {}
    rows = []

    def rd(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), places)

    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        skew, kurt = _adjusted_moments(n, r[f"g{i}"], r[f"k{i}"])
        rows.append((c, int(n), rd(r[f"a{i}"]), rd(r[f"s{i}"]), rd(r[f"lo{i}"]), rd(q.get((c, (), 0.25))),
                     rd(q.get((c, (), 0.5))), rd(q.get((c, (), 0.75))), rd(r[f"hi{i}"]), rd(skew), rd(kurt)))
    return spark.createDataFrame(rows, "column string, count long, mean double, std double, min double, "
                                       "p25 double, p50 double, p75 double, max double, skewness double, "
                                       "kurtosis double")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) including the NULL group; partial aggregation keeps hot values cheap."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def profile_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct classes (NULL counted), dominant class (smallest on ties), its count and share
    of all rows, cardinality class. One group-by over the unpivoted (column, value) pairs."""
    cols = cols or categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_unique long, top string, top_count long, "
                                                   "top_pct double, cardinality string")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("kv")).select("kv.*")
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    # dominant = max count, then smallest value; NULL never dominant (pandas mode drops NaN)
    per = vc.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.sum("c").alias("rows"),
        F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("c")).alias("nc"), F.col("value").alias("v"))))
        .alias("best"))
    top_count = F.coalesce(-F.col("best.nc"), F.lit(0)).cast("long")
    return per.select(
        "column", F.col("n_unique").cast("long").alias("n_unique"),
        F.coalesce(F.col("best.v"), F.lit("N/A")).alias("top"),
        top_count.alias("top_count"),
        (top_count / F.col("rows") * 100.0).alias("top_pct"),
        F.when(F.col("n_unique") > 30, "High").when(F.col("n_unique") == 2, "Binary").otherwise("Low/Med")
        .alias("cardinality"))


def _missing_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = [F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("long").alias("missing_count"),
                        F.col("__rows").alias("rows")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and % (2 dp), most missing first."""
    m = _missing_counts(df, df.columns)
    return (m.where(F.col("missing_count") > 0)
            .select("column", "missing_count",
                    F.round(F.col("missing_count") / F.col("rows") * 100.0, 2).alias("missing_pct"))
            .orderBy(F.desc("missing_count"), "column"))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any missing value, and their share."""
    any_missing = F.lit(False)
    for c in df.columns:
        any_missing = any_missing | missing(df, c)
    return df.agg(F.count_if(~any_missing).cast("long").alias("complete_rows"),
                  F.count(F.lit(1)).cast("long").alias("rows")).select(
        "complete_rows", "rows",
        F.when(F.col("rows") > 0, F.col("complete_rows") / F.col("rows") * 100.0).otherwise(0.0)
        .alias("complete_pct"))


def missing_matrix(df: DataFrame, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """0/1 missing indicators for a deterministic sample of ``n`` rows (top-n by md5(key|seed))."""
    h = seeded_hash([key], seed)
    sample = df.withColumn("__h", h).orderBy("__h", key).limit(n)
    return sample.select(F.col(key), *[F.when(missing(df, c), 1).otherwise(0).alias(c) for c in df.columns if c != key])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value counting NULL: min = max and (no NULL or all NULL).
    No distinct shuffle: one aggregate."""
    cols = df.columns
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        x = F.col(c)
        if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            x = F.to_json(x) if not isinstance(dt, T.MapType) else F.to_json(x)
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count_if(missing(df, c)).alias(f"z{i}"),
                 F.count_if(~missing(df, c)).alias(f"v{i}")]
    r = df.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cols):
        nn, nz = r[f"v{i}"], r[f"z{i}"]
        if nn == 0 or (nz == 0 and r[f"lo{i}"] == r[f"hi{i}"]):
            out.append(c)
    return out


def constant_columns_df(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in constant_columns(df)], "column string")


def cardinality_counts(df: DataFrame, cols: list[str] | None = None, high: int = 15) -> DataFrame:
    """Number of binary (=2 non-null distinct) and high-cardinality (> ``high``) categoricals."""
    cols = cols or categorical_columns(df)
    found = distinct_up_to(df, cols, max(2, high)).values()
    counts = (sum(n == 2 for n in found), sum(n > high for n in found))
    return df.sparkSession.createDataFrame([counts], "binary_count long, high_card_count long")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Target value counts (NULL excluded), most frequent first."""
    return (df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class"))
            .agg(F.count(F.lit(1)).cast("long").alias("count"))
            .orderBy(F.desc("count"), "class"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both profiles side by side plus deltas (after - before)."""
    b = profile_table(before).select(*[F.col(c).alias(f"before_{c}") for c in
                                       ["rows", "cols", "missing_count", "duplicate_count", "health_score"]])
    a = profile_table(after).select(*[F.col(c).alias(f"after_{c}") for c in
                                      ["rows", "cols", "missing_count", "duplicate_count", "health_score"]])
    j = b.crossJoin(a)  # one row each side: a 1 x 1 pairing, not a data cross join
    return j.select("*", *[(F.col(f"after_{c}") - F.col(f"before_{c}")).alias(f"delta_{c}")
                           for c in ["rows", "cols", "missing_count", "duplicate_count"]])


def exact_mean(c, integral: bool = False) -> tuple:
    """Aggregates for a mean that is exact when possible, read back with ``mean_of``: integral
    columns divide an exact long sum; fractional ones sum in decimal(38, 18) (overflow-safe via
    try_ functions); the double mean is the fallback."""
    x = F.col(c).cast("double")
    x = F.when(~F.isnan(x), x)
    if integral:
        exact = F.try_sum(F.col(c).cast("long")).cast("double") / F.count(F.col(c))
        d_n = F.count(F.col(c))
    else:
        d = F.expr(f"try_cast(`{c}` as decimal(38, 18))")
        exact = F.try_avg(d).cast("double")
        d_n = F.count(d)
    return (F.count(x).alias(f"__xn_{c}"), d_n.alias(f"__dn_{c}"), exact.alias(f"__da_{c}"), F.avg(x).alias(f"__xa_{c}"))


def mean_of(row, c):
    if row[f"__dn_{c}"] == row[f"__xn_{c}"] and row[f"__da_{c}"] is not None:
        return row[f"__da_{c}"]
    return row[f"__xa_{c}"]


def raw_profile(df: DataFrame, quantile_method: str = "auto", with_distinct: bool = False) -> dict:
    """Fitted raw schema: per numeric min/max/mean/median/std (1.0 when n <= 1; defaults when empty),
    per other column the first category in sorted order (and, on request, the distinct count).
    Small inputs: one aggregate including the exact medians; large inputs: that aggregate minus
    the medians, then the bounded-memory order-statistic path seeded with its counts."""
    from ..functions.order_stats import BUILTIN_PERCENTILE_BYTES, estimated_bytes
    num = numeric_columns(df)
    cat = [c for c in df.columns if c not in num]
    if quantile_method == "auto":
        quantile_method = "builtin" if estimated_bytes(df) <= BUILTIN_PERCENTILE_BYTES else "select"
    aggs = []
    for i, c in enumerate(num):
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        integral = isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), *exact_mean(c, integral)]
        if quantile_method == "builtin":
            aggs.append(F.percentile(x, 0.5).alias(f"md{i}"))
    for j, c in enumerate(cat):
        x = F.col(c).cast("string")
        aggs.append(F.min(x).alias(f"cf{j}"))
        if with_distinct:
            aggs.append(F.count_distinct(x).alias(f"cd{j}"))
    r = df.agg(*aggs).collect()[0] if aggs else None
    if quantile_method == "builtin":
        med = {(c, (), 0.5): r[f"md{i}"] for i, c in enumerate(num)}
    else:
        stats = {(c,): (r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(num)} if num else {}
        med = quantiles(df, num, [0.5], method=quantile_method, counts=stats) if num else {}
    out = {"columns": list(df.columns), "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields},
           "numeric": {}, "categorical": {}}
    for i, c in enumerate(num):
        n = r[f"n{i}"]
        if n == 0:
            out["numeric"][c] = {"min": 0.0, "max": 1.0, "mean": 0.0, "median": 0.0, "std": 1.0}
        else:
            out["numeric"][c] = {"min": r[f"lo{i}"], "max": r[f"hi{i}"], "mean": mean_of(r, c),
                                 "median": med[(c, (), 0.5)], "std": r[f"s{i}"] if n > 1 else 1.0}
    for j, c in enumerate(cat):
        out["categorical"][c] = {"first": r[f"cf{j}"]}
        if with_distinct:
            out["categorical"][c]["n_distinct"] = r[f"cd{j}"]
    return out


def raw_profile_df(df: DataFrame, places: int = 6) -> DataFrame:
    p = raw_profile(df, with_distinct=True)
    rows = []
    for c, s in p["numeric"].items():
        rows.append((c, "numeric", *(round(float(s[k]), places) for k in ["min", "max", "mean", "median", "std"]),
                     None, None))
    for c, s in p["categorical"].items():
        rows.append((c, "categorical", None, None, None, None, None, int(s["n_distinct"]), s["first"]))
    return df.sparkSession.createDataFrame(rows, "column string, role string, min double, max double, mean double, "
                                                 "median double, std double, n_distinct long, first_category string")


def data_checks(df: DataFrame) -> DataFrame:
    """Quality checklist: one row per missing column, per constant column, plus the duplicate check."""
    spark = df.sparkSession
    miss = missing_report(df).select(F.lit("missing").alias("check"), "column",
                                     F.col("missing_count").cast("double").alias("value"), F.lit(False).alias("ok"))
    consts = constant_columns(df)
    const_df = spark.createDataFrame([("constant", c, 1.0, False) for c in consts],
                                     "check string, column string, value double, ok boolean")
    prof = profile_table(df).select(F.lit("duplicates").alias("check"), F.lit(None).cast("string").alias("column"),
                                    F.col("duplicate_count").cast("double").alias("value"),
                                    (F.col("duplicate_count") == 0).alias("ok"))
    return miss.unionByName(const_df).unionByName(prof)
