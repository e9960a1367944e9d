"""Registered queries, part three: the exact neighbour search and what rests on it, curves of all classes,
missing numbers, the recorded pipeline and its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.knn import NeighborModel
from ..models.spark_ml import SparkModel
from ..operators import charts, encode, evaluate, impute, profile, sample, transform
from ..session import scratch_path
from ..sources import io
from . import inputs as I
from .catalog import query, rounded
from .catalog_models import DIM_COLS, _split_sql, embedding_columns
from .pipeline import Pipeline

# ---------------------------------------------------------------- models


def _near_sql(te: str, tr: str, key: str, dist: str, k: int, y: str) -> str:
    return f"""
nn AS (SELECT e.{key} AS id, t.{y} AS y, row_number() OVER (PARTITION BY e.{key} ORDER BY {dist}, t.{key}) AS rk FROM {te} e, {tr} t),
top AS (SELECT id, y FROM nn WHERE rk <= {k})"""


ORDERS_DIST = "(e.o_custkey - t.o_custkey) * (e.o_custkey - t.o_custkey) * 1.0 + (e.price - t.price) * (e.price - t.price)"


@query("clf_knn", f"""WITH o AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice / 100.0 AS price, o_orderpriority FROM orders),
{_split_sql("o", "o_orderkey")},
{_near_sql("test_rows", "train_rows", "o_orderkey", ORDERS_DIST, 5, "o_orderpriority")},
v AS (SELECT id, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS all_n,
             row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, y) AS rk FROM top GROUP BY id, y)
SELECT id AS o_orderkey, o_orderpriority, y AS prediction, round(n * 1.0 / all_n, 6) AS confidence FROM v JOIN test_rows ON o_orderkey = id WHERE rk = 1""")
def q_clf_knn(spark, sf):
    """The five nearest train orders by customer number and price vote on the priority of each test order."""
    o = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"),
                                            (F.col("o_totalprice") / 100.0).alias("price"), "o_orderpriority")
    train, test = sample.train_test(I.kept(sample.split_random(o, ["o_orderkey"], 0.2, 42)))
    m = NeighborModel("clf_knn", {"n_neighbors": 5}).fit(train, ["o_custkey", "price"], "o_orderpriority", "o_orderkey")
    return rounded(m.transform(test, key="o_orderkey").select("o_orderkey", "o_orderpriority", "prediction", "confidence"))


PART_DIST = "(e.p_size - t.p_size) * (e.p_size - t.p_size) * 1.0 + (e.p_partkey - t.p_partkey) * (e.p_partkey - t.p_partkey) * 1.0"


@query("reg_knn", f"""WITH {_split_sql("part", "p_partkey").lstrip()},
{_near_sql("test_rows", "train_rows", "p_partkey", PART_DIST, 5, "p_retailprice")}
SELECT id AS p_partkey, round(avg(y), 4) AS prediction FROM top GROUP BY id""")
def q_reg_knn(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    train, test = sample.train_test(sample.split_random(p, ["p_partkey"], 0.2, 42))
    m = NeighborModel("reg_knn", {"n_neighbors": 5}).fit(train, ["p_size", "p_partkey"], "p_retailprice", "p_partkey")
    return rounded(m.transform(test, key="p_partkey").select("p_partkey", "prediction"), 4)


@query("clf_knn_embeddings", """WITH e AS (SELECT vec_id, label, embedding FROM embeddings),
d AS (SELECT a.vec_id AS id, b.vec_id AS other, b.label AS y,
             list_sum(list_transform(generate_series(1, len(a.embedding)), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]))) AS d2
      FROM e a JOIN e b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
top AS (SELECT id, y FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rk FROM d) WHERE rk <= 7),
v AS (SELECT id, y, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, y) AS rk FROM top GROUP BY id, y)
SELECT id AS vec_id, y AS prediction FROM v WHERE rk = 1""")
def q_clf_knn_embeddings(spark, sf):
    """All dimensions of the embeddings: every fifth vector is classified by the others."""
    e = I.table(spark, sf, "embeddings")
    width = len(e.select("embedding").first()[0])
    cols = [f"e{i}" for i in range(width)]
    e = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    m = NeighborModel("clf_knn", {"n_neighbors": 7}).fit(e.where("vec_id % 5 <> 0"), cols, "label", "vec_id")
    return m.transform(e.where("vec_id % 5 = 0"), key="vec_id").select("vec_id", "prediction")


# ------------------------------------------------------------ imputation

PN_SQL = """(SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
CASE WHEN p_partkey % 7 = 2 THEN NULL ELSE p_retailprice END AS p_retailprice, CAST(p_partkey % 97 AS DOUBLE) AS p_slot FROM part)"""


def part_nulls(spark, sf):
    """part with p_size NULL where p_partkey % 10 = 3, p_retailprice NULL where % 7 = 2, and p_slot, the key modulo 97."""
    p = I.table(spark, sf, "part")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 10 == 3, None).otherwise(F.col("p_size").cast("double")).alias("p_size"),
                    F.when(F.col("p_partkey") % 7 == 2, None).otherwise(F.col("p_retailprice")).alias("p_retailprice"),
                    (F.col("p_partkey") % 97).cast("double").alias("p_slot"))


def _fill_sql(col: str) -> str:
    feats = ["p_size", "p_retailprice", "p_slot"]
    both = {f: f"(r.{f} IS NOT NULL AND g.{f} IS NOT NULL)" for f in feats}
    n = " + ".join(f"CAST({both[f]} AS INTEGER)" for f in feats)
    d = " + ".join(f"CASE WHEN {both[f]} THEN (r.{f} - g.{f}) * (r.{f} - g.{f}) ELSE 0.0 END" for f in feats)
    return f"""(SELECT k, avg(v) AS fill FROM (SELECT r.p_partkey AS k, g.{col} AS v, row_number() OVER (
  PARTITION BY r.p_partkey ORDER BY (3.0 / ({n})) * ({d}), g.p_partkey) AS rk FROM t r JOIN t g ON r.{col} IS NULL AND g.{col} IS NOT NULL AND ({n}) > 0) WHERE rk <= 5 GROUP BY k)"""


@query("impute_knn_features", f"""WITH t AS {PN_SQL}
SELECT t.p_partkey, round(coalesce(p_size, a.fill), 6) AS p_size, round(coalesce(p_retailprice, b.fill), 6) AS p_retailprice, p_slot
FROM t LEFT JOIN {_fill_sql("p_size")} a ON a.k = p_partkey LEFT JOIN {_fill_sql("p_retailprice")} b ON b.k = p_partkey""")
def q_impute_knn_features(spark, sf):
    """Two features with NULLs and one without: the mean of the five nearest rows that have the column."""
    p = part_nulls(spark, sf)
    out, _ = impute.impute(p, ["p_size", "p_retailprice", "p_slot"], "knn", n_neighbors=5, key="p_partkey")
    return rounded(out)


# ------------------------------------------------------------- balancing

_BITS = "md5(concat_ws('|', CAST({k} AS VARCHAR), '42', CAST(j AS VARCHAR)))"


@query("balance_smote", f"""WITH t AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(quality AS DOUBLE) AS quality, toxic FROM {I.LD_SQL} q),
sz AS (SELECT toxic, count(*) AS n FROM t GROUP BY toxic),
lack AS (SELECT toxic, n, (SELECT max(n) FROM sz) - n AS m FROM sz WHERE n < (SELECT max(n) FROM sz)),
kk AS (SELECT least(5, greatest(1, min(n) - 1)) AS k FROM sz),
own AS (SELECT t.*, m // n + CASE WHEN row_number() OVER (PARTITION BY t.toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42')) <= m % n THEN 1 ELSE 0 END AS times
        FROM t JOIN lack USING (toxic)),
nn AS (SELECT a.doc_id, b.n_chars AS n2, b.quality AS q2, row_number() OVER (PARTITION BY a.doc_id ORDER BY
         (a.n_chars - b.n_chars) * (a.n_chars - b.n_chars) + (a.quality - b.quality) * (a.quality - b.quality), b.doc_id) AS rk
       FROM own a JOIN own b ON a.toxic = b.toxic AND a.doc_id <> b.doc_id),
made AS (SELECT *, unnest(generate_series(1, times)) AS j FROM own),
b AS (SELECT *, CAST('0x' || substr({_BITS.format(k='doc_id')}, 1, 8) AS BIGINT) % (SELECT k FROM kk) + 1 AS pick,
             CAST('0x' || substr({_BITS.format(k='doc_id')}, 9, 8) AS BIGINT) / 4294967296.0 AS u FROM made)
SELECT n_chars, quality, toxic FROM t
UNION ALL SELECT round(b.n_chars + u * (n2 - b.n_chars), 6), round(b.quality + u * (q2 - b.quality), 6), toxic FROM b JOIN nn ON nn.doc_id = b.doc_id AND nn.rk = b.pick""")
def q_balance_smote(spark, sf):
    """Labelled documents, the rarer class raised to the size of the other by rows between neighbours."""
    return rounded(sample.smote(I.labelled_documents(spark, sf), "doc_id", "toxic", ["n_chars", "quality"]))


# ------------------------------------------- curves of every class at once

KNN_SQL = f"""WITH o AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice / 100.0 AS price, o_orderpriority FROM orders),
{_split_sql("o", "o_orderkey")},
{_near_sql("test_rows", "train_rows", "o_orderkey", ORDERS_DIST, 5, "o_orderpriority")},
cls AS (SELECT DISTINCT o_orderpriority AS class FROM train_rows),
sc AS (SELECT class, score, count_if(o_orderpriority = class) AS pos, count_if(o_orderpriority <> class) AS neg FROM (
  SELECT t.o_orderkey, t.o_orderpriority, class, (SELECT count(*) FROM top WHERE id = t.o_orderkey AND y = class) / 5.0 AS score FROM test_rows t, cls)
  GROUP BY class, score),
tot AS (SELECT class, sum(pos) AS P, sum(neg) AS N FROM sc GROUP BY class HAVING sum(pos) > 0 AND sum(neg) > 0),
cu AS (SELECT sc.*, P, N, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS rn
       FROM sc JOIN tot USING (class) WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""


def knn_scored(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"),
                                            (F.col("o_totalprice") / 100.0).alias("price"), "o_orderpriority")
    train, test = sample.train_test(I.kept(sample.split_random(o, ["o_orderkey"], 0.2, 42)))
    m = NeighborModel("clf_knn", {"n_neighbors": 5}).fit(train, ["o_custkey", "price"], "o_orderpriority", "o_orderkey")
    return m.transform(test, key="o_orderkey"), m.classes


@query("roc_curve_ovr", KNN_SQL + """
SELECT class, 0.0 AS fpr, 0.0 AS tpr, CAST('inf' AS DOUBLE) AS threshold FROM tot
UNION ALL SELECT class, round(fp * 1.0 / N, 6), round(tp * 1.0 / P, 6), score FROM cu WHERE npos IS NULL OR rn = 1 OR npos <> pos OR nneg <> neg""")
def q_roc_curve_ovr(spark, sf):
    """Every class against the rest, from the unrounded shares of the neighbours."""
    scored, classes = knn_scored(spark, sf)
    return rounded(evaluate.roc_curves(scored, "o_orderpriority", "probability", classes))


@query("roc_auc_ovr", KNN_SQL + """
SELECT class, round(sum(neg * (2.0 * tp - pos)) / (2.0 * max(P) * max(N)), 6) AS auc FROM cu GROUP BY class""")
def q_roc_auc_ovr(spark, sf):
    scored, classes = knn_scored(spark, sf)
    return rounded(evaluate.roc_aucs(scored, "o_orderpriority", "probability", classes))


@query("pr_curve_ovr", KNN_SQL + """
SELECT class, round(tp * 1.0 / P, 6) AS recall, round(tp * 1.0 / (tp + fp), 6) AS precision, score AS threshold FROM cu WHERE tp - pos < P
UNION ALL SELECT class, 0.0, 1.0, NULL FROM tot""")
def q_pr_curve_ovr(spark, sf):
    scored, classes = knn_scored(spark, sf)
    return rounded(evaluate.pr_curves(scored, "o_orderpriority", "probability", classes))


# ---------------------------------------------------- missing numbers (NaN)

#: part with p_retailprice NaN where p_partkey % 11 = 4 and p_size NULL where % 13 = 5; in SQL both are NULL
PNAN_SQL = """(SELECT p_partkey, CASE WHEN p_partkey % 13 = 5 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
CASE WHEN p_partkey % 11 = 4 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)"""


def part_nan(spark, sf):
    p = I.table(spark, sf, "part")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 13 == 5, None).otherwise(F.col("p_size").cast("double")).alias("p_size"),
                    F.when(F.col("p_partkey") % 11 == 4, float("nan")).otherwise(F.col("p_retailprice")).alias("p_retailprice"))


@query("describe_numeric_nan", f"""WITH t AS {PNAN_SQL}
SELECT 'p_size' AS "column", count(p_size) AS count, round(avg(p_size), 3) AS mean, round(stddev_samp(p_size), 3) AS std, min(p_size) AS min,
       round(quantile_cont(p_size, 0.25), 3) AS p25, round(quantile_cont(p_size, 0.5), 3) AS p50, round(quantile_cont(p_size, 0.75), 3) AS p75, max(p_size) AS max FROM t
UNION ALL SELECT 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 3), round(stddev_samp(p_retailprice), 3), min(p_retailprice),
       round(quantile_cont(p_retailprice, 0.25), 3), round(quantile_cont(p_retailprice, 0.5), 3), round(quantile_cont(p_retailprice, 0.75), 3), max(p_retailprice) FROM t""")
def q_describe_numeric_nan(spark, sf):
    """By the path for large tables, which the small one must agree with (tests)."""
    return profile.describe_numeric(part_nan(spark, sf), ["p_size", "p_retailprice"], quantile_method="select").drop("skewness", "kurtosis")


@query("histogram_nan", f"""WITH t AS {PNAN_SQL}, m AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 30 AS w FROM t)
SELECT bin, round(any_value(lo) + bin * any_value(w), 6) AS bin_start, round(any_value(lo) + (bin + 1) * any_value(w), 6) AS bin_end, count(*) AS count FROM (
  SELECT least(29, CAST(floor((p_retailprice - lo) / w) AS INTEGER)) AS bin, lo, w FROM t, m WHERE p_retailprice IS NOT NULL) GROUP BY bin""")
def q_histogram_nan(spark, sf):
    return rounded(charts.histogram(part_nan(spark, sf), "p_retailprice", 30))


@query("ols_trend_nan", f"""SELECT round(regr_slope(p_retailprice, p_partkey), 6) AS slope, round(regr_intercept(p_retailprice, p_partkey), 6) AS intercept,
round(regr_r2(p_retailprice, p_partkey), 6) AS r2, regr_count(p_retailprice, p_partkey) AS n FROM {PNAN_SQL} t""")
def q_ols_trend_nan(spark, sf):
    return rounded(charts.ols_trend(part_nan(spark, sf), "p_partkey", "p_retailprice"))


@query("correlation_matrix_nan", f"""WITH t AS {PNAN_SQL}, c AS (SELECT corr(p_size, p_retailprice) AS sp, corr(p_size, p_partkey) AS sk, corr(p_retailprice, p_partkey) AS pk FROM t)
SELECT a AS col_a, b AS col_b, round(v, 6) AS corr FROM c, LATERAL (VALUES ('p_partkey', 'p_partkey', 1.0::DOUBLE), ('p_size', 'p_size', 1.0), ('p_retailprice', 'p_retailprice', 1.0),
 ('p_size', 'p_retailprice', sp), ('p_retailprice', 'p_size', sp), ('p_size', 'p_partkey', sk), ('p_partkey', 'p_size', sk), ('p_retailprice', 'p_partkey', pk), ('p_partkey', 'p_retailprice', pk)) v(a, b, v)""")
def q_correlation_matrix_nan(spark, sf):
    return rounded(charts.correlation_matrix(part_nan(spark, sf), ["p_partkey", "p_size", "p_retailprice"]))


@query("pca_nan", f"""WITH t AS {PNAN_SQL}, d AS (SELECT p_size AS x, p_retailprice AS y FROM t WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL),
m AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM d),
e AS (SELECT (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM m)
SELECT 'PC_1' AS component, round(l1 / (l1 + l2), 6) AS ratio, round(l1 / (l1 + l2), 6) AS cumulative FROM e UNION ALL SELECT 'PC_2', round(l2 / (l1 + l2), 6), 1.0 FROM e""")
def q_pca_nan(spark, sf):
    """Explained variance of two unstandardised columns, from their eigenvalues in closed form."""
    st = transform.fit_pca(part_nan(spark, sf), ["p_size", "p_retailprice"], 2, standardize=False)
    return rounded(transform.explained_variance(st, spark))


_EMB_LONG = "(SELECT vec_id, unnest(generate_series(0, 63)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"


@query("correlation_embeddings", f"""WITH e AS {_EMB_LONG}
SELECT 'x' || a.i AS col_a, 'x' || b.i AS col_b, CASE WHEN a.i = b.i THEN 1.0 ELSE round(corr(a.x, b.x), 6) END AS corr FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i""")
def q_correlation_embeddings(spark, sf):
    """All pairs of the 64 dimensions in one pass."""
    return rounded(charts.correlation_matrix(embedding_columns(spark, sf), DIM_COLS))


# ---------------------------------------------------- pipeline and its input


def recorded_pipeline(spark, sf):
    from ..operators import clean
    li = I.table(spark, sf, "lineitem")
    pipe = Pipeline().init_from_raw(li, target="l_returnflag")
    df = pipe.fit_step(li, clean.fit_drop(["l_partkey", "l_suppkey"]), "drop ids")
    df = pipe.fit_step(df, impute.fit_impute(df, ["l_quantity"], "mean"), "impute mean l_quantity")
    return pipe, li


@query("required_raw_features", """SELECT column_name AS feature FROM information_schema.columns
WHERE table_name = 'lineitem' AND column_name NOT IN ('l_returnflag', 'l_partkey', 'l_suppkey')""")
def q_required_raw_features(spark, sf):
    pipe, _ = recorded_pipeline(spark, sf)
    return spark.createDataFrame([(c,) for c in pipe.required_raw_features()], "feature string")


@query("pipeline_record", """SELECT * FROM (VALUES (1, 'drop', 'drop ids'), (2, 'impute', 'impute mean l_quantity')) v(seq, stage, entry)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def q_pipeline_record(spark, sf):
    pipe, _ = recorded_pipeline(spark, sf)
    return Pipeline.from_json(pipe.to_json()).log_table(spark)


@query("validate_raw_input", """SELECT 'error' AS level, 'l_tax' AS "column", 'missing required feature column' AS message
UNION ALL SELECT 'warning', 'note', 'extra column ignored'
UNION ALL SELECT 'error', 'l_quantity', 'expects numerical values' FROM lineitem HAVING count(try_cast('q' || l_quantity AS DOUBLE)) = 0
UNION ALL SELECT 'error', 'l_discount', 'expects numerical values' FROM lineitem HAVING count(try_cast(CAST(l_discount AS VARCHAR) AS DOUBLE)) = 0""")
def q_validate_raw_input(spark, sf):
    """A column short, one too many, one whose text is no number, and one whose text is."""
    pipe, li = recorded_pipeline(spark, sf)
    raw = li.drop("l_tax").withColumn("note", F.lit("x")).withColumn("l_quantity", F.concat(F.lit("q"), F.col("l_quantity").cast("string")))
    return pipe.validate_raw_input(raw.withColumn("l_discount", F.col("l_discount").cast("string")))


@query("preset_random", """SELECT 'random' AS preset, p_size * 1.0 AS p_size, p_retailprice, p_brand FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || '|42'), p_partkey LIMIT 1""")
def q_preset_random(spark, sf):
    """A random raw row to start a single prediction from (the limit is the feature)."""
    from ..operators.profile import raw_profile
    from ..operators.validate import preset_rows
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    rows = preset_rows(raw_profile(p.drop("p_partkey")), spark, raw_df=p, key="p_partkey")
    return rows.where(F.col("preset") == "random").select("preset", "p_size", "p_retailprice", "p_brand")


@query("encode_label_saved", """WITH d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_name || '#' || (p_partkey % 3) AS v FROM part))
SELECT p_partkey, CAST(code AS INTEGER) AS name FROM part JOIN d ON d.v = p_name || '#' || (p_partkey % 3)""")
def q_encode_label_saved(spark, sf):
    """A dictionary of nearly as many values as rows, saved with a pipeline and loaded again before it is applied."""
    p = I.table(spark, sf, "part").select("p_partkey", "p_size", F.concat("p_name", F.lit("#"), (F.col("p_partkey") % 3).cast("string")).alias("name"))
    pipe = Pipeline().append(encode.fit_index(p, ["name"], "label"), "label name")
    m = SparkModel("reg_decision_tree", {"max_depth": 2}).fit(p, ["p_partkey"], "p_size")
    path = scratch_path(spark, "label-model")
    io.save_model(m, pipe, path)
    _, again = io.load_model(path)
    return again.stages[0].apply(p).select("p_partkey", "name")
