"""Registered queries: one per operator, each reading whole given tables, with the independent
DuckDB text of the same computation where SQL can state it.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame``; ``ORACLES[name] = sql``.
Computed doubles are rounded (6 places unless stated) on both sides; counts are bigint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import charts, clean, encode, impute, outliers, profile, sample, scale, transform
from . import inputs as I

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """round(x * 10^p) / 10^p: the same double arithmetic as the SQL side, so ties land alike."""
    k = float(10 ** places)
    return df.select(*[(F.round(F.col(f.name) * k, 0) / k).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _miss(c: str, is_float: bool = False) -> str:
    return f"({c} IS NULL OR isnan({c}))" if is_float else f"({c} IS NULL)"


def _profile_sql(src: str, cols: list[tuple[str, bool]], n_num: int, n_cat: int) -> str:
    miss = " + ".join(f"CASE WHEN {_miss(c, fl)} THEN 1 ELSE 0 END" for c, fl in cols)
    k = len(cols)
    names = ", ".join(c for c, _ in cols)
    return f"""
WITH t AS (SELECT {names} FROM {src} s),
a AS (SELECT count(*) AS n, sum({miss}) AS m FROM t),
d AS (SELECT count(*) AS dn FROM (SELECT DISTINCT * FROM t)),
p AS (SELECT n, m, n - dn AS dup, m * 100.0 / (n * {k}) AS mp, (n - dn) * 100.0 / n AS dp FROM a, d)
SELECT CAST(n AS BIGINT) AS rows, {k} AS cols, {n_num} AS numeric_count, {n_cat} AS categorical_count,
       CAST(m AS BIGINT) AS missing_count, round(mp, 6) AS missing_pct, CAST(dup AS BIGINT) AS duplicate_count,
       round(dp, 6) AS duplicate_pct,
       CAST(GREATEST(10, LEAST(100, 100 - CASE WHEN mp > 0 THEN LEAST(35, CAST(floor(mp * 1.5) AS INTEGER)) ELSE 0 END
                                     - CASE WHEN dp > 0 THEN LEAST(25, CAST(floor(dp * 1.2) AS INTEGER)) ELSE 0 END
                                     - {20 if k < 2 else 0})) AS INTEGER) AS health_score
FROM p"""


# =============================================================== profiling

@query("profile_table", _profile_sql(I.LQ_SQL, [("l_quantity", True), ("l_discount", True), ("l_returnflag", False),
                                                ("l_linestatus", False)], 2, 2))
def q_profile_table(spark, sf):
    t = I.lineitem_nulls(spark, sf).select("l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return rounded(profile.profile_table(t))


LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
          "l_linestatus", "l_shipdate"]


@query("profile_table_whole", _profile_sql(I.LQ_SQL, [(c, c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for c in LI_ALL], 8, 2))
def q_profile_table_whole(spark, sf):
    """Every column of the table: hardly any duplicates, so hardly any whole row is compared."""
    return rounded(profile.profile_table(I.lineitem_nulls(spark, sf).select(LI_ALL)))


@query("health_score", f"""
WITH t AS (SELECT event_type, value FROM {I.EV_SQL} s),
a AS (SELECT count(*) AS n, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END + CASE WHEN event_type IS NULL THEN 1 ELSE 0 END) AS m FROM t),
d AS (SELECT count(*) AS dn FROM (SELECT DISTINCT * FROM t)),
p AS (SELECT m * 100.0 / (n * 2) AS mp, (n - dn) * 100.0 / n AS dp FROM a, d)
SELECT CAST(GREATEST(10, LEAST(100, 100 - CASE WHEN mp > 0 THEN LEAST(35, CAST(floor(mp * 1.5) AS INTEGER)) ELSE 0 END
                              - CASE WHEN dp > 0 THEN LEAST(25, CAST(floor(dp * 1.2) AS INTEGER)) ELSE 0 END)) AS INTEGER)
       AS health_score FROM p""")
def q_health_score(spark, sf):
    return profile.health_score(I.events_nulls(spark, sf).select("event_type", "value"))


def _schema_sql():
    cols = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
            ("c_mktsegment", "string")]
    parts = []
    for i, (c, dt) in enumerate(cols):
        parts.append(f"""SELECT '{c}' AS column, '{dt}' AS dtype,
  CAST(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS BIGINT) AS n_unique,
  CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
  round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct,
  coalesce(CAST(arg_min({c}, c_custkey) FILTER (WHERE {c} IS NOT NULL) AS VARCHAR), 'None') AS sample_value,
  {i} AS position FROM {I.CU_SQL} t""")
    return "\nUNION ALL\n".join(parts)


@query("schema_table", _schema_sql())
def q_schema_table(spark, sf):
    return rounded(profile.schema_table(I.customer_nulls(spark, sf), "c_custkey"))


@query("head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 15")
def q_head(spark, sf):
    return profile.head(I.table(spark, sf, "orders"), "o_orderkey", 15)


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(src, cols, places):
    parts = []
    for c in cols:
        r = lambda e: f"round({e}, {places})"
        parts.append(f"""SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, {r(f'avg({c})')} AS mean,
  {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS p25,
  {r(f'quantile_cont({c}, 0.5)')} AS p50, {r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'max({c})')} AS max,
  {r(f'skewness({c})')} AS skewness, {r(f'kurtosis({c})')} AS kurtosis FROM {src}""")
    return "\nUNION ALL\n".join(parts)


@query("describe_numeric", _describe_sql("lineitem", LI_NUM, 4))
def q_describe_numeric(spark, sf):
    return rounded(profile.describe_numeric(I.table(spark, sf, "lineitem"), LI_NUM, places=12), 4)


@query("describe_numeric_select", _describe_sql(I.EV_SQL + " e", ["value", "user_id"], 4))
def q_describe_numeric_select(spark, sf):
    """Same report with the bounded-memory order-statistic path forced (the 100 TB path)."""
    return rounded(profile.describe_numeric(I.events_nulls(spark, sf), ["value", "user_id"], places=12,
                                            quantile_method="select"), 4)


def _profile_cat_sql(src, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT * FROM (
WITH vc AS (SELECT {c} AS v, count(*) AS c FROM {src} GROUP BY {c}),
top AS (SELECT v, c FROM vc WHERE v IS NOT NULL ORDER BY c DESC, v LIMIT 1)
SELECT '{c}' AS column, CAST((SELECT count(*) FROM vc) AS BIGINT) AS n_unique,
  coalesce((SELECT v FROM top), 'N/A') AS top, CAST(coalesce((SELECT c FROM top), 0) AS BIGINT) AS top_count,
  round(coalesce((SELECT c FROM top), 0) * 100.0 / (SELECT sum(c) FROM vc), 6) AS top_pct,
  CASE WHEN (SELECT count(*) FROM vc) > 30 THEN 'High' WHEN (SELECT count(*) FROM vc) = 2 THEN 'Binary'
       ELSE 'Low/Med' END AS cardinality)""")
    return "\nUNION ALL\n".join(parts)


@query("profile_categorical", _profile_cat_sql("part", ["p_name", "p_brand", "p_type"]))
def q_profile_categorical(spark, sf):
    return rounded(profile.profile_categorical(I.table(spark, sf, "part"), ["p_name", "p_brand", "p_type"]))


EV_COLS = [("event_id", False), ("ts", False), ("user_id", False), ("event_type", False), ("value", True),
           ("props", False)]


@query("missing_report", "\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{c}' AS column, CAST(count_if({_miss(c, fl)}) AS BIGINT) AS missing_count, "
    f"round(count_if({_miss(c, fl)}) * 100.0 / count(*), 2) AS missing_pct FROM {I.EV_SQL} e) WHERE missing_count > 0"
    for c, fl in EV_COLS))
def q_missing_report(spark, sf):
    return profile.missing_report(I.events_nulls(spark, sf))


@query("complete_rows", f"""
SELECT CAST(count_if(NOT ({' OR '.join(_miss(c, fl) for c, fl in EV_COLS)})) AS BIGINT) AS complete_rows,
       CAST(count(*) AS BIGINT) AS rows,
       round(count_if(NOT ({' OR '.join(_miss(c, fl) for c, fl in EV_COLS)})) * 100.0 / count(*), 6) AS complete_pct
FROM {I.EV_SQL} e""")
def q_complete_rows(spark, sf):
    return rounded(profile.complete_rows(I.events_nulls(spark, sf)))


@query("missing_matrix", f"""
SELECT event_id, {', '.join(f'CAST({_miss(c, fl)} AS INTEGER) AS {c}' for c, fl in EV_COLS if c != 'event_id')}
FROM {I.EV_SQL} e ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id LIMIT 500""")
def q_missing_matrix(spark, sf):
    return profile.missing_matrix(I.events_nulls(spark, sf), "event_id", 500, 42)


OF_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
           "o_after_1990", "o_neg_priority"]


def _constant_sql():
    parts = [f"SELECT '{c}' AS column FROM {I.OF_SQL} o HAVING count(DISTINCT {c}) + "
             f"CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END <= 1" for c in OF_COLS]
    return "\nUNION ALL\n".join(parts)


@query("constant_columns", _constant_sql())
def q_constant_columns(spark, sf):
    return profile.constant_columns_df(I.orders_flags(spark, sf))


@query("drop_constant", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
                        f"FROM {I.OF_SQL} o")
def q_drop_constant(spark, sf):
    out, _ = clean.drop_constant(I.orders_flags(spark, sf))
    return out


@query("cardinality_counts", """
SELECT CAST((count(DISTINCT p_name) = 2)::INT + (count(DISTINCT p_brand) = 2)::INT + (count(DISTINCT p_type) = 2)::INT
            + (count(DISTINCT c_flag) = 2)::INT AS BIGINT) AS binary_count,
       CAST((count(DISTINCT p_name) > 15)::INT + (count(DISTINCT p_brand) > 15)::INT + (count(DISTINCT p_type) > 15)::INT
            + (count(DISTINCT c_flag) > 15)::INT AS BIGINT) AS high_card_count
FROM (SELECT p_name, p_brand, p_type, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c_flag FROM part)""")
def q_cardinality_counts(spark, sf):
    p = I.table(spark, sf, "part").withColumn("c_flag", F.when(F.col("p_size") > 25, "big").otherwise("small"))
    return profile.cardinality_counts(p, ["p_name", "p_brand", "p_type", "c_flag"])


@query("class_distribution", "SELECT l_returnflag AS class, CAST(count(*) AS BIGINT) AS count FROM lineitem "
                             "WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag")
def q_class_distribution(spark, sf):
    return profile.class_distribution(I.table(spark, sf, "lineitem"), "l_returnflag")


@query("before_after", """
WITH b AS (SELECT l_quantity, l_discount FROM lineitem),
a AS (SELECT DISTINCT l_quantity, l_discount FROM lineitem),
pb AS (SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS dup FROM b),
pa AS (SELECT count(*) AS rows FROM a),
hb AS (SELECT rows, dup, dup * 100.0 / rows AS dp FROM pb)
SELECT CAST(hb.rows AS BIGINT) AS before_rows, 2 AS before_cols, CAST(0 AS BIGINT) AS before_missing_count,
       CAST(hb.dup AS BIGINT) AS before_duplicate_count,
       CAST(GREATEST(10, LEAST(100, 100 - CASE WHEN dp > 0 THEN LEAST(25, CAST(floor(dp * 1.2) AS INTEGER)) ELSE 0 END)) AS INTEGER)
         AS before_health_score,
       CAST(pa.rows AS BIGINT) AS after_rows, 2 AS after_cols, CAST(0 AS BIGINT) AS after_missing_count,
       CAST(0 AS BIGINT) AS after_duplicate_count, 100 AS after_health_score,
       CAST(pa.rows - hb.rows AS BIGINT) AS delta_rows, 0 AS delta_cols, CAST(0 AS BIGINT) AS delta_missing_count,
       CAST(0 - hb.dup AS BIGINT) AS delta_duplicate_count
FROM hb, pa""")
def q_before_after(spark, sf):
    b = I.table(spark, sf, "lineitem").select("l_quantity", "l_discount")
    a = clean.dedup(b)
    return profile.before_after(b, a)


@query("raw_profile", f"""
SELECT 'c_custkey' AS column, 'numeric' AS role, round(min(c_custkey), 6) AS min, round(max(c_custkey), 6) AS max,
  round(avg(c_custkey), 6) AS mean, round(median(c_custkey), 6) AS median, round(stddev_samp(c_custkey), 6) AS std,
  CAST(NULL AS BIGINT) AS n_distinct, CAST(NULL AS VARCHAR) AS first_category FROM {I.CU_SQL} c
UNION ALL
SELECT 'c_nationkey', 'numeric', round(min(c_nationkey), 6), round(max(c_nationkey), 6), round(avg(c_nationkey), 6),
  round(median(c_nationkey), 6), round(stddev_samp(c_nationkey), 6), NULL, NULL FROM {I.CU_SQL} c
UNION ALL
SELECT 'c_acctbal', 'numeric', round(min(c_acctbal), 6), round(max(c_acctbal), 6), round(avg(c_acctbal), 6),
  round(median(c_acctbal), 6), round(stddev_samp(c_acctbal), 6), NULL, NULL FROM {I.CU_SQL} c
UNION ALL
SELECT 'c_name', 'categorical', NULL, NULL, NULL, NULL, NULL, CAST(count(DISTINCT c_name) AS BIGINT), min(c_name) FROM {I.CU_SQL} c
UNION ALL
SELECT 'c_mktsegment', 'categorical', NULL, NULL, NULL, NULL, NULL, CAST(count(DISTINCT c_mktsegment) AS BIGINT),
  min(c_mktsegment) FROM {I.CU_SQL} c""")
def q_raw_profile(spark, sf):
    return profile.raw_profile_df(I.customer_nulls(spark, sf))


@query("data_checks", f"""
SELECT * FROM (SELECT 'missing' AS "check", 'value' AS column, CAST(count_if(value IS NULL) AS DOUBLE) AS value, false AS ok FROM {I.EV_SQL} e)
UNION ALL
SELECT * FROM (SELECT 'missing', 'props', CAST(count_if(props IS NULL) AS DOUBLE), false FROM {I.EV_SQL} e)
UNION ALL
SELECT 'duplicates', NULL, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {I.EV_SQL} d)) AS DOUBLE),
       count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM {I.EV_SQL} d)) FROM {I.EV_SQL} e""")
def q_data_checks(spark, sf):
    return profile.data_checks(I.events_nulls(spark, sf))


# ================================================================ cleaning

EV_ALL = "event_id, ts, user_id, event_type, value, props"


@query("dedup_first", f"""
SELECT {EV_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn
FROM events) WHERE rn = 1""")
def q_dedup_first(spark, sf):
    return clean.dedup(I.table(spark, sf, "events"), ["user_id", "event_type"], "first", "event_id")


@query("dedup_last", f"""
SELECT {EV_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn
FROM events) WHERE rn = 1""")
def q_dedup_last(spark, sf):
    return clean.dedup(I.table(spark, sf, "events"), ["user_id", "event_type"], "last", "event_id")


@query("dedup_none", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) WHERE n = 1""")
def q_dedup_none(spark, sf):
    return clean.dedup(I.table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], False)


@query("dedup_all_columns", "SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM lineitem")
def q_dedup_all_columns(spark, sf):
    return clean.dedup(I.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_returnflag"))


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def q_drop_columns(spark, sf):
    return clean.drop_columns(I.table(spark, sf, "orders"), ["o_orderpriority", "not_a_column"])


@query("drop_missing_rows", f"SELECT * FROM {I.EV_SQL} e WHERE value IS NOT NULL AND props IS NOT NULL")
def q_drop_missing_rows(spark, sf):
    return clean.drop_missing_rows(I.events_nulls(spark, sf), "any")


@query("drop_missing_rows_thresh", f"SELECT * FROM {I.EV_SQL} e WHERE "
                                   f"(value IS NOT NULL)::INT + (props IS NOT NULL)::INT + 4 >= 5")
def q_drop_missing_rows_thresh(spark, sf):
    return clean.drop_missing_rows(I.events_nulls(spark, sf), thresh=5)


@query("drop_missing_columns", f"SELECT event_id, ts, user_id, event_type FROM {I.EV_SQL} e")
def q_drop_missing_columns(spark, sf):
    out, _ = clean.drop_missing_columns(I.events_nulls(spark, sf), "any")
    return out


@query("drop_high_missing", f"SELECT event_id, ts, user_id, event_type, value FROM {I.EV_SQL} e")
def q_drop_high_missing(spark, sf):
    out, _ = clean.drop_high_missing(I.events_nulls(spark, sf), 12.0)
    return out


@query("select_numeric", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_select_numeric(spark, sf):
    return clean.select_numeric(I.table(spark, sf, "orders"))


@query("select_categorical", "SELECT o_orderstatus, o_orderpriority FROM orders")
def q_select_categorical(spark, sf):
    return clean.select_categorical(I.table(spark, sf, "orders"))


@query("candidate_scale_columns", """
SELECT "column" FROM (
  SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) AS d, 0 AS pos FROM customer
  UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), 1 FROM customer
  UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal), 2 FROM customer
  UNION ALL SELECT 'c_flag', count(DISTINCT CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END), 3 FROM customer) WHERE d > 2""")
def q_candidate_scale_columns(spark, sf):
    c = I.table(spark, sf, "customer").withColumn("c_flag", F.when(F.col("c_acctbal") > 0, 1).otherwise(0))
    cols = clean.candidate_scale_columns(c)
    return spark.createDataFrame([(x,) for x in cols], "column string")


# ============================================================== imputation

@query("impute_mean", f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {I.EV_SQL} a)), 6) AS value "
                      f"FROM {I.EV_SQL} e")
def q_impute_mean(spark, sf):
    out, _ = impute.impute(I.events_nulls(spark, sf), ["value"], "mean")
    return rounded(out.select("event_id", "value"))


@query("impute_median", f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {I.EV_SQL} a)), 6) AS value "
                        f"FROM {I.EV_SQL} e")
def q_impute_median(spark, sf):
    out, _ = impute.impute(I.events_nulls(spark, sf), ["value"], "median")
    return rounded(out.select("event_id", "value"))


@query("impute_mode", f"""
WITH t AS {I.EV_SQL},
mv AS (SELECT value AS v FROM t WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1),
mp AS (SELECT props AS v FROM t WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1)
SELECT event_id, round(coalesce(value, (SELECT v FROM mv)), 6) AS value, coalesce(props, (SELECT v FROM mp)) AS props FROM t""")
def q_impute_mode(spark, sf):
    out, _ = impute.impute(I.events_nulls(spark, sf), ["value", "props"], "mode")
    return rounded(out.select("event_id", "value", "props"))


@query("impute_constant", f"SELECT event_id, coalesce(props, 'Missing') AS props, round(coalesce(value, -1.0), 6) AS value "
                          f"FROM {I.EV_SQL} e")
def q_impute_constant(spark, sf):
    e = I.events_nulls(spark, sf)
    out, _ = impute.impute(e, ["props"], "constant")
    out, _ = impute.impute(out, ["value"], "constant", -1.0)
    return rounded(out.select("event_id", "props", "value"))


@query("impute_knn", f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {I.EV_SQL} a)), 6) AS value "
                     f"FROM {I.EV_SQL} e")
def q_impute_knn(spark, sf):
    """KNN fitted on the column alone: no other feature gives a distance, so every row's
    neighbours are all donors and the fill is the column mean (the reference's result)."""
    out, _ = impute.impute(I.events_nulls(spark, sf), ["value"], "knn", n_neighbors=5, scope="column")
    return rounded(out.select("event_id", "value"))


@query("impute_iterative", f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {I.EV_SQL} a)), 6) AS value "
                           f"FROM {I.EV_SQL} e")
def q_impute_iterative(spark, sf):
    out, _ = impute.impute(I.events_nulls(spark, sf), ["value"], "iterative", scope="column")
    return rounded(out.select("event_id", "value"))


@query("impute_global", f"""
WITH t AS {I.EV_SQL},
mp AS (SELECT props AS v FROM t WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1),
me AS (SELECT event_type AS v FROM t WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, ts, round(CAST(user_id AS DOUBLE), 6) AS user_id, coalesce(event_type, (SELECT v FROM me)) AS event_type,
       round(coalesce(value, (SELECT avg(value) FROM t)), 6) AS value, coalesce(props, (SELECT v FROM mp)) AS props FROM t""")
def q_impute_global(spark, sf):
    e = I.events_nulls(spark, sf)
    st = impute.fit_impute_global(e, "mean", exclude=["event_id"])
    return rounded(st.apply(e))


@query("impute_plan", f"""
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {I.EV_SQL} a)), 6) AS value,
       coalesce(props, 'none') AS props FROM {I.EV_SQL} e""")
def q_impute_plan(spark, sf):
    e = I.events_nulls(spark, sf)
    st = impute.fit_impute_plan(e, {"value": "median", "props": ("constant", "none")})
    return rounded(st.apply(e).select("event_id", "value", "props"))


@query("fallback_fill", f"""
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {I.EV_SQL} a)), 6) AS value,
       coalesce(props, (SELECT min(props) FROM {I.EV_SQL} b)) AS props FROM {I.EV_SQL} e""")
def q_fallback_fill(spark, sf):
    e = I.events_nulls(spark, sf)
    st = impute.fit_fallback(profile.raw_profile(e))
    return rounded(st.apply(e).select(F.col("event_id").cast("long").alias("event_id"), "value", "props"))


# ================================================================ outliers

def _iqr_cte(src, c, factor=1.5, name="b"):
    return (f"{name} AS (SELECT quantile_cont({c}, 0.25) - {factor} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
            f"quantile_cont({c}, 0.75) + {factor} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {src})")


@query("outlier_iqr_clip", f"""
WITH t AS {I.EV_SQL}, {_iqr_cte('t', 'value')}
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE GREATEST(b.lo, LEAST(b.hi, value)) END, 6) AS value
FROM t, b""")
def q_outlier_iqr_clip(spark, sf):
    out, _, _ = outliers.clip_outliers(I.events_nulls(spark, sf), ["value"], "iqr", factor=1.5)
    return rounded(out.select("event_id", "value"))


@query("outlier_iqr_remove", f"""
WITH t AS (SELECT event_id, value, CAST(user_id AS DOUBLE) AS user_id FROM {I.EV_SQL} e), {_iqr_cte('t', 'value', 1.0, 'b1')},
t1 AS (SELECT t.* FROM t, b1 WHERE value IS NULL OR (value >= b1.lo AND value <= b1.hi)),
{_iqr_cte('t1', 'user_id', 1.0, 'b2')},
t2 AS (SELECT t1.* FROM t1, b2 WHERE user_id IS NULL OR (user_id >= b2.lo AND user_id <= b2.hi))
SELECT event_id FROM t2""")
def q_outlier_iqr_remove(spark, sf):
    out, _ = outliers.remove_outliers(I.events_nulls(spark, sf), ["value", "user_id"], "iqr", factor=1.0,
                                      mode="sequential")
    return out.select("event_id")


@query("outlier_zscore_clip", f"""
WITH t AS {I.EV_SQL}, b AS (SELECT avg(value) - 3.0 * stddev_samp(value) AS lo, avg(value) + 3.0 * stddev_samp(value) AS hi FROM t)
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE GREATEST(b.lo, LEAST(b.hi, value)) END, 6) AS value
FROM t, b""")
def q_outlier_zscore_clip(spark, sf):
    out, _, _ = outliers.clip_outliers(I.events_nulls(spark, sf), ["value"], "zscore")
    return rounded(out.select("event_id", "value"))


@query("outlier_zscore_remove", f"""
WITH t AS {I.EV_SQL}, b AS (SELECT avg(value) - 2.0 * stddev_samp(value) AS lo, avg(value) + 2.0 * stddev_samp(value) AS hi FROM t)
SELECT event_id FROM t, b WHERE value IS NULL OR (value >= b.lo AND value <= b.hi)""")
def q_outlier_zscore_remove(spark, sf):
    out, _ = outliers.remove_outliers(I.events_nulls(spark, sf), ["value"], "zscore", factor=2.0)
    return out.select("event_id")


@query("outlier_winsorize", f"""
WITH t AS {I.EV_SQL},
r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rk, count(*) OVER () AS n FROM t WHERE value IS NOT NULL),
b AS (SELECT max(CASE WHEN rk = CAST(floor(0.05 * n) AS BIGINT) THEN value END) AS lo,
             max(CASE WHEN rk = n - CAST(floor(0.05 * n) AS BIGINT) - 1 THEN value END) AS hi FROM r)
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE GREATEST(b.lo, LEAST(b.hi, value)) END, 6) AS value
FROM t, b""")
def q_outlier_winsorize(spark, sf):
    out, _, _ = outliers.clip_outliers(I.events_nulls(spark, sf), ["value"], "winsorize", lower_pct=0.05, upper_pct=0.05)
    return rounded(out.select("event_id", "value"))


@query("outlier_count", f"""
WITH t AS (SELECT value, CAST(user_id AS DOUBLE) AS user_id FROM {I.EV_SQL} e), {_iqr_cte('t', 'value', 1.5, 'b1')},
{_iqr_cte('t', 'user_id', 1.5, 'b2')}
SELECT 'value' AS column, round(b1.lo, 6) AS lower, round(b1.hi, 6) AS upper,
       CAST(count_if(value < b1.lo OR value > b1.hi) AS BIGINT) AS n_out FROM t, b1 GROUP BY b1.lo, b1.hi
UNION ALL
SELECT 'user_id', round(b2.lo, 6), round(b2.hi, 6), CAST(count_if(user_id < b2.lo OR user_id > b2.hi) AS BIGINT)
FROM t, b2 GROUP BY b2.lo, b2.hi""")
def q_outlier_count(spark, sf):
    e = I.events_nulls(spark, sf)
    b = outliers.iqr_bounds(e, ["value", "user_id"], 1.5)
    return rounded(outliers.outlier_count(e, b))


# ================================================================ encoding

@query("encode_recommend", """
SELECT "column", n_distinct, CASE WHEN n_distinct <= 2 THEN 'label' WHEN n_distinct <= 10 THEN 'one_hot'
                                ELSE 'frequency' END AS method FROM (
  SELECT 'p_name' AS column, CAST(count(DISTINCT p_name) AS BIGINT) AS n_distinct FROM part
  UNION ALL SELECT 'p_brand', CAST(count(DISTINCT p_brand) AS BIGINT) FROM part
  UNION ALL SELECT 'p_type', CAST(count(DISTINCT p_type) AS BIGINT) FROM part
  UNION ALL SELECT 'c_flag', CAST(count(DISTINCT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END) AS BIGINT) FROM part)""")
def q_encode_recommend(spark, sf):
    p = I.table(spark, sf, "part").withColumn("c_flag", F.when(F.col("p_size") > 25, "big").otherwise("small"))
    return encode.encode_recommend(p, ["p_name", "p_brand", "p_type", "c_flag"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # fixed values: o_orderpriority in the data


@query("encode_one_hot", "SELECT o_orderkey, o_totalprice, " + ", ".join(
    f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\"" for v in PRIORITIES) + " FROM orders")
def q_encode_one_hot(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return encode.fit_one_hot(o, ["o_orderpriority"]).apply(o)


@query("encode_one_hot_capped", """
WITH vc AS (SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name),
top AS (SELECT p_name FROM vc ORDER BY n DESC, p_name LIMIT 29),
m AS (SELECT CASE WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE 'Other' END AS cat FROM part)
SELECT 'p_name_' || cat AS dummy, CAST(count(*) AS BIGINT) AS ones FROM m GROUP BY cat""")
def q_encode_one_hot_capped(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_name")
    enc = encode.fit_one_hot(p, ["p_name"]).apply(p)
    dummies = [c for c in enc.columns if c.startswith("p_name_")]
    wide = enc.agg(*[F.sum(F.col(f"`{c}`")).cast("long").alias(f"s{i}") for i, c in enumerate(dummies)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dummy"), F.col(f"s{i}").alias("ones"))
                                           for i, c in enumerate(dummies)])).alias("e")).select("e.*")


@query("encode_label", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, 'Missing')) - 1 AS INTEGER) AS p_brand FROM part""")
def q_encode_label(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_brand")
    return encode.fit_index(p, ["p_brand"], "label").apply(p)


@query("encode_ordinal", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'Missing')) - 1 AS DOUBLE) AS o_orderpriority
FROM orders""")
def q_encode_ordinal(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.fit_index(o, ["o_orderpriority"], "ordinal").apply(o)


@query("encode_frequency", """
SELECT p_partkey, round(coalesce(count(*) OVER (PARTITION BY p_type) * 1.0 /
  (SELECT count(*) FROM part WHERE p_type IS NOT NULL), 0.0), 6) AS p_type FROM part""")
def q_encode_frequency(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_type")
    return rounded(encode.fit_frequency(p, ["p_type"]).apply(p))


# ============================================================== transforms

@query("transform_log1p", """
WITH m AS (SELECT min(c_acctbal) AS mn FROM customer)
SELECT c_custkey, round(ln(1 + c_acctbal + CASE WHEN mn <= 0 THEN abs(mn) + 1 ELSE 0 END), 6) AS c_acctbal
FROM customer, m""")
def q_transform_log1p(spark, sf):
    c = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(transform.fit_log1p(c, ["c_acctbal"]).apply(c))


@query("transform_box_cox", """
WITH m AS (SELECT min(c_acctbal) AS mn FROM customer),
y AS (SELECT c_custkey, (power(c_acctbal + CASE WHEN mn <= 0 THEN abs(mn) + 1 ELSE 0 END, 0.5) - 1) / 0.5 AS y
      FROM customer, m),
s AS (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM y)
SELECT c_custkey, round((y - mu) / sd, 6) AS c_acctbal FROM y, s""")
def q_transform_box_cox(spark, sf):
    c = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(transform.fit_power(c, ["c_acctbal"], "box-cox", lambdas={"c_acctbal": 0.5}).apply(c))


@query("transform_yeo_johnson", """
WITH y AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN (power(c_acctbal + 1, 0.7) - 1) / 0.7
                                  ELSE -(power(1 - c_acctbal, 2 - 0.7) - 1) / (2 - 0.7) END AS y FROM customer),
s AS (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM y)
SELECT c_custkey, round((y - mu) / sd, 6) AS c_acctbal FROM y, s""")
def q_transform_yeo_johnson(spark, sf):
    c = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(transform.fit_power(c, ["c_acctbal"], "yeo-johnson", lambdas={"c_acctbal": 0.7}).apply(c))


@query("transform_power_mle")
def q_transform_power_mle(spark, sf):
    """Box-Cox with the maximum-likelihood lambda (grid search in Spark aggregates)."""
    c = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(transform.fit_power(c, ["c_acctbal"], "box-cox").apply(c))


@query("poly_features", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, round(CAST(p_size AS DOUBLE) * p_size, 6) AS "p_size^2",
       round(p_size * p_retailprice, 6) AS "p_size p_retailprice", round(p_retailprice * p_retailprice, 6) AS "p_retailprice^2"
FROM part""")
def q_poly_features(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(transform.fit_poly(p, ["p_size", "p_retailprice"], 2).apply(p))


@query("poly_interaction_bias", """
SELECT p_partkey, 1.0 AS "1", CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(p_partkey AS DOUBLE) AS p_partkey_f,
  round(p_size * p_retailprice, 6) AS "p_size p_retailprice", round(CAST(p_size AS DOUBLE) * p_partkey, 6) AS "p_size p_partkey_f",
  round(p_retailprice * p_partkey, 6) AS "p_retailprice p_partkey_f",
  round(p_size * p_retailprice * p_partkey, 6) AS "p_size p_retailprice p_partkey_f"
FROM part""")
def q_poly_interaction_bias(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice",
                                          F.col("p_partkey").cast("double").alias("p_partkey_f"))
    st = transform.fit_poly(p, ["p_size", "p_retailprice", "p_partkey_f"], 3, interaction_only=True, include_bias=True)
    return rounded(st.apply(p))


@query("pca_fixed", """
WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2,
                  corr(p_size, p_retailprice) AS r FROM part)
SELECT p_partkey, round(((p_size - m1) / s1 + sign(r) * (p_retailprice - m2) / s2) / sqrt(2), 6) AS PC_1 FROM part, s""")
def q_pca_fixed(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(transform.fit_pca(p, ["p_size", "p_retailprice"], 1, standardize=True).apply(p))


@query("pca_variance")
def q_pca_variance(spark, sf):
    """Smallest k whose cumulative explained variance reaches 0.9, with the per-component ratios."""
    li = I.table(spark, sf, "lineitem")
    st = transform.fit_pca(li, LI_NUM, 0.9, standardize=True)
    return rounded(transform.explained_variance(st, spark))


@query("explained_variance")
def q_explained_variance(spark, sf):
    """All dimensions of the embeddings."""
    e = I.table(spark, sf, "embeddings")
    width = len(e.select("embedding").first()[0])
    cols = [f"e{i}" for i in range(width)]
    emb = e.select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    st = transform.fit_pca(emb, cols, width, standardize=False)
    return rounded(transform.explained_variance(st, spark))


@query("infer_problem_type", """
SELECT 'l_returnflag' AS target, 'Classification' AS problem_type
UNION ALL SELECT 'l_quantity', CASE WHEN count(DISTINCT l_quantity) > 10 THEN 'Regression' ELSE 'Classification' END FROM lineitem
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) > 10 THEN 'Regression' ELSE 'Classification' END FROM lineitem""")
def q_infer_problem_type(spark, sf):
    li = I.table(spark, sf, "lineitem")
    rows = [(t, transform.infer_problem_type(li, t)) for t in ["l_returnflag", "l_quantity", "l_linenumber"]]
    return spark.createDataFrame(rows, "target string, problem_type string")


@query("mutual_information", """
WITH mm AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
long AS (SELECT 'l_linestatus' AS feature, l_linestatus AS x, l_returnflag AS y FROM lineitem
         UNION ALL
         SELECT 'l_quantity', CAST(LEAST(9, CAST(floor((l_quantity - lo) / (hi - lo) * 10) AS INTEGER)) AS VARCHAR), l_returnflag
         FROM lineitem, mm),
j AS (SELECT feature, x, y, count(*) AS nxy FROM long WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY feature, x, y),
t AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, x) AS nx,
             sum(nxy) OVER (PARTITION BY feature, y) AS ny FROM j)
SELECT feature, round(sum(nxy * 1.0 / n * ln(nxy * n * 1.0 / (nx * ny))), 6) AS mutual_info FROM t GROUP BY feature""")
def q_mutual_information(spark, sf):
    li = I.table(spark, sf, "lineitem")
    return rounded(transform.mutual_information(li, ["l_linestatus", "l_quantity"], "l_returnflag", bins=10))


# =============================================================== balancing

@query("balance_undersample", f"""
WITH t AS {I.LD_SQL}, m AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM t GROUP BY toxic))
SELECT doc_id, n_chars, quality, toxic FROM (
  SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42')) AS rn FROM t)
WHERE rn <= (SELECT k FROM m)""")
def q_balance_undersample(spark, sf):
    return sample.undersample(I.labelled_documents(spark, sf), ["doc_id"], "toxic", 42)


@query("balance_table", f"SELECT n_chars, quality, toxic FROM {I.LD_SQL} t")
def q_balance_table(spark, sf):
    return sample.balance_table(I.labelled_documents(spark, sf), "toxic", exclude=["doc_id"])


# ================================================================= scaling

def _scaled_sql(expr_size, expr_price, stats):
    return f"""WITH s AS ({stats})
SELECT p_partkey, round({expr_size}, 6) AS p_size, round({expr_price}, 6) AS p_retailprice FROM part, s"""


@query("scale_standard", _scaled_sql("(p_size - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END",
                                     "(p_retailprice - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END",
                                     "SELECT avg(p_size) m1, stddev_pop(p_size) s1, avg(p_retailprice) m2, "
                                     "stddev_pop(p_retailprice) s2 FROM part"))
def q_scale_standard(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(scale.fit_scaler(p, ["p_size", "p_retailprice"], "standard").apply(p))


@query("scale_minmax", _scaled_sql("(p_size - a1) / CASE WHEN b1 = a1 THEN 1 ELSE b1 - a1 END",
                                   "(p_retailprice - a2) / CASE WHEN b2 = a2 THEN 1 ELSE b2 - a2 END",
                                   "SELECT min(p_size) a1, max(p_size) b1, min(p_retailprice) a2, max(p_retailprice) b2 FROM part"))
def q_scale_minmax(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(scale.fit_scaler(p, ["p_size", "p_retailprice"], "minmax").apply(p))


@query("scale_robust", _scaled_sql("(p_size - m1) / CASE WHEN i1 = 0 THEN 1 ELSE i1 END",
                                   "(p_retailprice - m2) / CASE WHEN i2 = 0 THEN 1 ELSE i2 END",
                                   "SELECT median(p_size) m1, quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) i1, "
                                   "median(p_retailprice) m2, quantile_cont(p_retailprice, 0.75) - "
                                   "quantile_cont(p_retailprice, 0.25) i2 FROM part"))
def q_scale_robust(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(scale.fit_scaler(p, ["p_size", "p_retailprice"], "robust").apply(p))


@query("scale_maxabs", _scaled_sql("p_size / CASE WHEN x1 = 0 THEN 1 ELSE x1 END",
                                   "p_retailprice / CASE WHEN x2 = 0 THEN 1 ELSE x2 END",
                                   "SELECT max(abs(p_size)) x1, max(abs(p_retailprice)) x2 FROM part"))
def q_scale_maxabs(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(scale.fit_scaler(p, ["p_size", "p_retailprice"], "maxabs").apply(p))


@query("scale_normalizer", """
SELECT p_partkey, round(p_size / nrm, 6) AS p_size, round(p_retailprice / nrm, 6) AS p_retailprice FROM (
  SELECT *, CASE WHEN sqrt(p_size * p_size + p_retailprice * p_retailprice) = 0 THEN 1
                 ELSE sqrt(p_size * p_size + p_retailprice * p_retailprice) END AS nrm FROM part)""")
def q_scale_normalizer(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(scale.fit_scaler(p, ["p_size", "p_retailprice"], "normalizer").apply(p))


# ============================================================== chart data

@query("histogram", """
WITH m AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
b AS (SELECT LEAST(19, CAST(floor((l_extendedprice - lo) / w) AS INTEGER)) AS bin FROM lineitem, m
      WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, CAST(count(*) AS BIGINT) AS count
FROM b, m GROUP BY bin, lo, w""")
def q_histogram(spark, sf):
    return rounded(charts.histogram(I.table(spark, sf, "lineitem"), "l_extendedprice", 20))


@query("histogram_grouped", """
WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events),
b AS (SELECT LEAST(9, CAST(floor((value - lo) / w) AS INTEGER)) AS bin, event_type FROM events, m WHERE value IS NOT NULL)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, event_type,
       CAST(count(*) AS BIGINT) AS count FROM b, m GROUP BY bin, event_type, lo, w""")
def q_histogram_grouped(spark, sf):
    return rounded(charts.histogram(I.table(spark, sf, "events"), "value", 10, "event_type"))


@query("box_stats", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS med,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag)
SELECT l.l_returnflag, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END), 6) AS whisker_low,
  round(max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 6) AS whisker_high,
  CAST(count_if(l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag GROUP BY l.l_returnflag, q1, med, q3""")
def q_box_stats(spark, sf):
    return rounded(charts.box_stats(I.table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("box_stats_events", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS med,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT l.event_type, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) AS whisker_low,
  round(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_high,
  CAST(count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM events l JOIN q ON l.event_type = q.event_type GROUP BY l.event_type, q1, med, q3""")
def q_box_stats_events(spark, sf):
    """Grouped quartiles through the bounded-memory order-statistic path."""
    return rounded(charts.box_stats(I.table(spark, sf, "events"), "value", "event_type", quantile_method="select"))


@query("scatter_sample", """
SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || '|42'), p_partkey LIMIT 500""")
def q_scatter_sample(spark, sf):
    return charts.scatter_sample(I.table(spark, sf, "part"), ["p_size", "p_retailprice"], "p_partkey", 500)


@query("scatter_3d", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y,
       round(CAST(embedding[3] AS DOUBLE), 6) AS z, label FROM embeddings""")
def q_scatter_3d(spark, sf):
    e = I.table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n)
                                                            for i, n in enumerate("xyz")], "label")
    return rounded(charts.scatter_sample(e, ["x", "y", "z", "label"], "vec_id"))


@query("scatter_3d_sample", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y,
       round(CAST(embedding[3] AS DOUBLE), 6) AS z, label FROM embeddings
ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id LIMIT 200""")
def q_scatter_3d_sample(spark, sf):
    """A sample of 200 points, which is the feature; ``scatter_3d`` is every point."""
    e = I.table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n)
                                                            for i, n in enumerate("xyz")], "label")
    return rounded(charts.scatter_sample(e, ["x", "y", "z", "label"], "vec_id", 200))


@query("scatter_points", "SELECT p_partkey, p_size, p_retailprice FROM part")
def q_scatter_points(spark, sf):
    """Every point; ``scatter_sample`` is a sample of 500."""
    return charts.scatter_sample(I.table(spark, sf, "part"), ["p_size", "p_retailprice"], "p_partkey")


@query("scatter_3d_points", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y,
       round(CAST(embedding[3] AS DOUBLE), 6) AS z, label FROM embeddings""")
def q_scatter_3d_points(spark, sf):
    """Every point; ``scatter_3d_sample`` is a sample of 200."""
    e = I.table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n)
                                                            for i, n in enumerate("xyz")], "label")
    return rounded(charts.scatter_sample(e, ["x", "y", "z", "label"], "vec_id"))


@query("ols_trend", """
SELECT p_type, round(regr_slope(p_retailprice, p_partkey), 6) AS slope, round(regr_intercept(p_retailprice, p_partkey), 6) AS intercept,
       round(regr_r2(p_retailprice, p_partkey), 6) AS r2, CAST(regr_count(p_retailprice, p_partkey) AS BIGINT) AS n
FROM part GROUP BY p_type""")
def q_ols_trend(spark, sf):
    return rounded(charts.ols_trend(I.table(spark, sf, "part"), "p_partkey", "p_retailprice", "p_type"))


def _corr_sql():
    parts = []
    for a in LI_NUM:
        for b in LI_NUM:
            src = "" if a == b else " FROM lineitem"
            e = "1.0" if a == b else f"round(corr({a}, {b}), 6)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({e} AS DOUBLE) AS corr{src}")
    return "\nUNION ALL\n".join(parts)


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf):
    return rounded(charts.correlation_matrix(I.table(spark, sf, "lineitem"), LI_NUM))


@query("category_counts", """
SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS count,
       round(count(*) * 1.0 / (SELECT count(*) FROM orders WHERE o_orderpriority IS NOT NULL), 6) AS share
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def q_category_counts(spark, sf):
    return rounded(charts.category_counts(I.table(spark, sf, "orders"), "o_orderpriority"))
