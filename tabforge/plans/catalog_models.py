"""Registered queries, part two: splits, models, evaluation, the fitted pipeline and scoring,
sources/sinks and the streaming replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.naive_bayes import GaussianNB
from ..models.spark_ml import ClusterModel, SparkModel, fit_kmeans, kmeans_assign
from ..operators import clean, encode, evaluate, impute, outliers, profile, sample, scale, transform
from ..plans.pipeline import Pipeline, align_features, score_batch, score_batch_metrics
from ..session import scratch_path
from ..sources import io
from . import inputs as I
from .catalog import LI_NUM, query, rounded

TARGET = "l_returnflag"
FLAG_FEATURES = LI_NUM + ["l_linestatus_F", "l_linestatus_O"]


# ------------------------------------------------------------ the flagship

def fit_flagship(train):
    """median impute -> IQR clip -> one-hot -> standard scale, recorded as a replayable pipeline."""
    pipe = Pipeline().init_from_raw(train, target=TARGET)
    df = pipe.fit_step(train, impute.fit_impute(train, ["l_quantity"], "median"), "impute median l_quantity")
    df = pipe.fit_step(df, outliers.fit_outliers(df, LI_NUM, "iqr", factor=1.5), "clip IQR")
    df = pipe.fit_step(df, encode.fit_one_hot(df, ["l_linestatus"]), "one-hot l_linestatus")
    df = pipe.fit_step(df, scale.fit_scaler(df, LI_NUM, "standard"), "standard scale")
    pipe.set_features(FLAG_FEATURES)
    return pipe, df


def flagship_scored(spark, sf):
    raw = I.lineitem_keyed_nulls(spark, sf)
    split = I.kept(sample.split_random(raw, ["l_key"], 0.2, 42))
    train, test = sample.train_test(split)
    pipe, prepared = fit_flagship(train.drop("l_key"))
    nb = GaussianNB().fit(prepared, FLAG_FEATURES, TARGET)
    return pipe, nb, score_batch(pipe, nb, test, keep=["l_key"])


def _flagship_prep_sql(src_train: str, src_apply: str, carry: str = "") -> str:
    """CTEs: pipeline statistics from ``src_train`` applied to ``src_apply`` -> ``prep``
    (``carry``: extra columns of ``src_apply`` passed through, written with a leading comma)."""
    q = []
    for c in LI_NUM:
        q.append(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}")
    clip = ", ".join(f"GREATEST(q1_{c} - 1.5 * (q3_{c} - q1_{c}), LEAST(q3_{c} + 1.5 * (q3_{c} - q1_{c}), {c})) AS {c}"
                     for c in LI_NUM)
    mom = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in LI_NUM)
    scaled = ", ".join(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END AS {c}" for c in LI_NUM)
    return f"""
med AS (SELECT median(l_quantity) AS mq FROM {src_train}),
fill_t AS (SELECT l_key, l_returnflag, l_linestatus, coalesce(l_quantity, mq) AS l_quantity, l_extendedprice, l_discount,
                  l_tax FROM {src_train}, med),
qs AS (SELECT {', '.join(q)} FROM fill_t),
clip_t AS (SELECT l_key, l_returnflag, l_linestatus, {clip} FROM fill_t, qs),
mom AS (SELECT {mom} FROM clip_t),
fill_a AS (SELECT l_key, l_returnflag, l_linestatus, coalesce(l_quantity, mq) AS l_quantity, l_extendedprice, l_discount,
                  l_tax{carry} FROM {src_apply}, med),
clip_a AS (SELECT l_key, l_returnflag, l_linestatus, {clip}{carry} FROM fill_a, qs),
prep AS (SELECT l_key, l_returnflag{carry}, {scaled}, CAST(l_linestatus = 'F' AS INTEGER) AS l_linestatus_F,
                CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_O FROM clip_a, mom)"""


def _nb_sql(train: str, test: str, feats: list[str], target: str, keys: str) -> str:
    """CTEs fitting Gaussian naive Bayes on ``train`` and scoring ``test`` -> ``js`` (one row per
    key and class: jll, mj = max jll, se = sum exp(jll - mj), rk = rank of the class)."""
    m = ", ".join(f"avg({f}) AS m{i}, var_pop({f}) AS v{i}" for i, f in enumerate(feats))
    gv = "GREATEST(" + ", ".join(f"var_pop({f})" for f in feats) + ")"
    c0 = "ln(n * 1.0 / ntot) - 0.5 * (" + " + ".join(f"ln(2 * pi() * (v{i} + eps))" for i in range(len(feats))) + ")"
    ws = ", ".join(f"m{i}, v{i} + eps AS w{i}" for i in range(len(feats)))
    jll = "c0 - (" + " + ".join(f"({f} - m{i}) * ({f} - m{i}) / (2 * w{i})" for i, f in enumerate(feats)) + ")"
    return f"""
nb_tr AS (SELECT * FROM {train}), nb_te AS (SELECT * FROM {test}),
cs AS (SELECT {target} AS cls, count(*) AS n, {m} FROM nb_tr WHERE {target} IS NOT NULL GROUP BY {target}),
gv AS (SELECT 1e-9 * {gv} AS eps, count(*) AS ntot FROM nb_tr WHERE {target} IS NOT NULL),
st AS (SELECT cls, {c0} AS c0, {ws} FROM cs, gv),
jl AS (SELECT nb_te.*, st.cls, {jll} AS jll FROM nb_te, st),
jm AS (SELECT *, max(jll) OVER (PARTITION BY {keys}) AS mj FROM jl),
js AS (SELECT *, sum(exp(jll - mj)) OVER (PARTITION BY {keys}) AS se,
              row_number() OVER (PARTITION BY {keys} ORDER BY jll DESC, cls) AS rk FROM jm)"""


def _split_sql(src: str, key: str, p: float = 0.2) -> str:
    return f"""
sp AS (SELECT *, row_number() OVER (ORDER BY md5({key} || '|42'), {key}) AS srn, count(*) OVER () AS sn FROM {src}),
train_rows AS (SELECT * EXCLUDE (srn, sn) FROM sp WHERE srn > CAST(ceil({p} * sn) AS BIGINT)),
test_rows AS (SELECT * EXCLUDE (srn, sn) FROM sp WHERE srn <= CAST(ceil({p} * sn) AS BIGINT))"""


LQK_SQL = ("(SELECT *, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
           f"CAST(round(l_extendedprice * 100) AS BIGINT)) AS l_key FROM {I.LQ_SQL} q)")

SCORE_SQL = f"""WITH raw AS {LQK_SQL}, {_split_sql('raw', 'l_key')},
both_rows AS (SELECT *, 'train' AS part FROM train_rows UNION ALL SELECT *, 'test' AS part FROM test_rows),
{_flagship_prep_sql('train_rows', 'both_rows', ', part')},
prep_tr AS (SELECT * FROM prep WHERE part = 'train'), prep_te AS (SELECT * FROM prep WHERE part = 'test'),
{_nb_sql('prep_tr', 'prep_te', FLAG_FEATURES, TARGET, 'l_key')}"""


@query("score_batch", SCORE_SQL + """
SELECT l_key, l_returnflag, cls AS Predicted_l_returnflag, round(1.0 / se, 6) AS Confidence,
       l_returnflag = cls AS Accurate FROM js WHERE rk = 1""")
def q_score_batch(spark, sf):
    _pipe, _nb, scored = flagship_scored(spark, sf)
    return rounded(scored)


BATCH_METRICS_SQL = SCORE_SQL + """,
pc AS (SELECT l_returnflag AS y, cls AS p, count(*) AS n FROM js WHERE rk = 1 GROUP BY 1, 2),
pcls AS (SELECT c AS cls, sum(tp) AS tp, sum(sup) AS sup, sum(pr) AS pr FROM (
    SELECT y AS c, CASE WHEN y = p THEN n ELSE 0 END AS tp, n AS sup, 0 AS pr FROM pc
    UNION ALL SELECT p, 0, 0, n FROM pc) GROUP BY c),
m AS (SELECT *, CASE WHEN pr > 0 THEN tp * 1.0 / pr ELSE 0 END AS prec, CASE WHEN sup > 0 THEN tp * 1.0 / sup ELSE 0 END AS rec FROM pcls)
"""
BATCH_METRICS = """round(sum(tp) * 1.0 / sum(sup), 6) AS accuracy, round(sum(prec * sup) / sum(sup), 6) AS precision,
       round(sum(rec * sup) / sum(sup), 6) AS recall,
       round(sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * sup) / sum(sup), 6) AS f1"""


@query("score_batch_metrics", BATCH_METRICS_SQL + f"SELECT {BATCH_METRICS} FROM m")
def q_score_batch_metrics(spark, sf):
    _pipe, _nb, scored = flagship_scored(spark, sf)
    return rounded(score_batch_metrics(scored, TARGET))


@query("pipeline_transform", f"""WITH raw AS {LQK_SQL}, {_flagship_prep_sql('raw', 'raw')}
SELECT l_key, l_returnflag, {', '.join(f'round({c}, 6) AS {c}' for c in LI_NUM)}, l_linestatus_F, l_linestatus_O FROM prep""")
def q_pipeline_transform(spark, sf):
    raw = I.lineitem_keyed_nulls(spark, sf)
    pipe, _ = fit_flagship(raw.drop("l_key"))
    return rounded(pipe.transform(raw, keep=["l_key", TARGET]))


@query("stream_replay", f"""WITH raw AS {LQK_SQL}, {_flagship_prep_sql('raw', 'raw')}
SELECT l_key, l_returnflag, {', '.join(f'round({c}, 6) AS {c}' for c in LI_NUM)}, l_linestatus_F, l_linestatus_O FROM prep""")
def q_stream_replay(spark, sf):
    """The fitted pipeline replayed on a file stream of the raw table (stateless per row)."""
    from ..streaming.replay import replay_stream
    raw = I.lineitem_keyed_nulls(spark, sf)
    pipe, _ = fit_flagship(raw.drop("l_key"))
    return rounded(replay_stream(spark, pipe, sf, "lineitem", I.add_lineitem_key_and_nulls, keep=["l_key", TARGET]))


@query("align_features", """
SELECT p_partkey, p_size, p_retailprice, 0.0 AS p_weight FROM part""")
def q_align_features(spark, sf):
    p = I.table(spark, sf, "part")
    return align_features(p, ["p_size", "p_retailprice", "p_weight"], extra=["p_partkey"])


# ----------------------------------------------------- naive Bayes + evaluation

NB_SRC = f"(SELECT l_key, l_returnflag, {', '.join(LI_NUM)} FROM {I.LK_SQL} k)"
NB_SQL = "WITH " + _nb_sql(NB_SRC, NB_SRC, LI_NUM, TARGET, "l_key").lstrip()


def nb_predictions(spark, sf):
    li = I.lineitem_keyed(spark, sf)
    nb = GaussianNB().fit(li, LI_NUM, TARGET)
    return nb, nb.transform(li.select("l_key", TARGET, *LI_NUM))


def _nb_param_sql():
    parts = []
    for i, f in enumerate(LI_NUM):
        parts.append(f"SELECT cls AS class, '{f}' AS feature, round(n * 1.0 / ntot, 4) AS prior, round(m{i}, 4) AS mean, "
                     f"round(v{i} + eps, 4) AS var FROM cs, gv")
    return NB_SQL + "\n" + "\nUNION ALL\n".join(parts)


@query("clf_gaussian_nb", _nb_param_sql())
def q_clf_gaussian_nb(spark, sf):
    nb, _ = nb_predictions(spark, sf)
    return rounded(nb.params_table(spark), 4)


@query("nb_predict", NB_SQL + """
SELECT l_key, l_returnflag, cls AS prediction, round(1.0 / se, 6) AS confidence FROM js WHERE rk = 1""")
def q_nb_predict(spark, sf):
    _, p = nb_predictions(spark, sf)
    return rounded(p.select("l_key", TARGET, "prediction", "confidence"))


@query("decode_predictions", NB_SQL + """
SELECT l_key, CAST(rk_idx AS INTEGER) AS prediction_index, cls AS prediction FROM (
  SELECT l_key, cls, rk, dense_rank() OVER (ORDER BY cls) - 1 AS rk_idx FROM js) WHERE rk = 1""")
def q_decode_predictions(spark, sf):
    _, p = nb_predictions(spark, sf)
    return p.select("l_key", "prediction_index", "prediction")


PRED1 = " WHERE rk = 1"


@query("metrics_classification", NB_SQL + """,
pc AS (SELECT l_returnflag AS y, cls AS p, count(*) AS n FROM js WHERE rk = 1 GROUP BY 1, 2),
pcls AS (SELECT c AS cls, sum(tp) AS tp, sum(sup) AS sup, sum(pr) AS pr FROM (
    SELECT y AS c, CASE WHEN y = p THEN n ELSE 0 END AS tp, n AS sup, 0 AS pr FROM pc
    UNION ALL SELECT p, 0, 0, n FROM pc) GROUP BY c),
m AS (SELECT *, CASE WHEN pr > 0 THEN tp * 1.0 / pr ELSE 0 END AS prec, CASE WHEN sup > 0 THEN tp * 1.0 / sup ELSE 0 END AS rec FROM pcls)
SELECT round(sum(tp) * 1.0 / sum(sup), 6) AS accuracy, round(sum(prec * sup) / sum(sup), 6) AS precision,
       round(sum(rec * sup) / sum(sup), 6) AS recall,
       round(sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * sup) / sum(sup), 6) AS f1 FROM m""")
def q_metrics_classification(spark, sf):
    _, p = nb_predictions(spark, sf)
    return rounded(evaluate.metrics_classification(p, TARGET, "prediction"))


@query("classification_report", NB_SQL + """,
pc AS (SELECT l_returnflag AS y, cls AS p, count(*) AS n FROM js WHERE rk = 1 GROUP BY 1, 2),
pcls AS (SELECT c AS cls, sum(tp) AS tp, sum(sup) AS sup, sum(pr) AS pr FROM (
    SELECT y AS c, CASE WHEN y = p THEN n ELSE 0 END AS tp, n AS sup, 0 AS pr FROM pc
    UNION ALL SELECT p, 0, 0, n FROM pc) GROUP BY c),
m AS (SELECT *, CASE WHEN pr > 0 THEN tp * 1.0 / pr ELSE 0 END AS prec, CASE WHEN sup > 0 THEN tp * 1.0 / sup ELSE 0 END AS rec FROM pcls),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM m)
SELECT cls AS "row", round(prec, 4) AS precision, round(rec, 4) AS recall, round(f1, 4) AS f1, CAST(sup AS BIGINT) AS support
FROM f WHERE sup > 0
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) * 1.0 / sum(sup), 4), CAST(sum(sup) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(prec), 4), round(avg(rec), 4), round(avg(f1), 4), CAST(sum(sup) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(prec * sup) / sum(sup), 4), round(sum(rec * sup) / sum(sup), 4),
                 round(sum(f1 * sup) / sum(sup), 4), CAST(sum(sup) AS BIGINT) FROM f""")
def q_classification_report(spark, sf):
    _, p = nb_predictions(spark, sf)
    return evaluate.classification_report(p, TARGET, "prediction")


@query("confusion_matrix", NB_SQL + """,
pc AS (SELECT l_returnflag AS y, cls AS p, count(*) AS n FROM js WHERE rk = 1 GROUP BY 1, 2),
lab AS (SELECT y AS l FROM pc UNION SELECT p FROM pc)
SELECT a.l AS actual, b.l AS predicted, CAST(coalesce(pc.n, 0) AS BIGINT) AS count
FROM lab a CROSS JOIN lab b LEFT JOIN pc ON pc.y = a.l AND pc.p = b.l""")
def q_confusion_matrix(spark, sf):
    _, p = nb_predictions(spark, sf)
    return evaluate.confusion_matrix(p, TARGET, "prediction")


@query("filter_predictions", NB_SQL + "\nSELECT l_key FROM js WHERE rk = 1 AND cls <> l_returnflag")
def q_filter_predictions(spark, sf):
    _, p = nb_predictions(spark, sf)
    keyed = p.select("l_key", (F.col(TARGET) == F.col("prediction")).alias("Accurate"))
    return clean.filter_predictions(keyed, "misclassified").select("l_key")


@query("predictions_table", NB_SQL + """
SELECT l_returnflag AS Actual, cls AS Predicted, l_returnflag = cls AS Accurate FROM js WHERE rk = 1""")
def q_predictions_table(spark, sf):
    _, p = nb_predictions(spark, sf)
    return evaluate.predictions_table(p, TARGET, "prediction")


PROB_R = NB_SQL + """,
probs AS (SELECT l_key, l_returnflag AS y, round(exp(jll - mj) / se, 8) AS score FROM js WHERE cls = 'R'),
sc AS (SELECT score, sum(CASE WHEN y = 'R' THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 'R' THEN 0 ELSE 1 END) AS neg
       FROM probs GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                 sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
                 lead(pos) OVER (ORDER BY score DESC) AS npos, lead(neg) OVER (ORDER BY score DESC) AS nneg,
                 row_number() OVER (ORDER BY score DESC) AS rn FROM sc)"""


def nb_scores(spark, sf):
    _, p = nb_predictions(spark, sf)
    return p.withColumn("score", F.round(F.element_at("probability", 3), 8))  # class 'R' (sorted A, N, R)


@query("roc_curve", PROB_R + """
SELECT 0.0 AS fpr, 0.0 AS tpr, CAST('inf' AS DOUBLE) AS threshold
UNION ALL
SELECT round(fp * 1.0 / N, 6), round(tp * 1.0 / P, 6), round(score, 6) FROM cu, tot
WHERE npos IS NULL OR rn = 1 OR npos <> pos OR nneg <> neg""")
def q_roc_curve(spark, sf):
    return rounded(evaluate.roc_curve(nb_scores(spark, sf), TARGET, "score", "R"))


@query("roc_auc_score", PROB_R + """
SELECT round(sum(neg * (2 * tp - pos)) * 1.0 / (2.0 * max(P) * max(N)), 6) AS auc FROM cu, tot""")
def q_roc_auc_score(spark, sf):
    return rounded(evaluate.roc_auc(nb_scores(spark, sf), TARGET, "score", "R"))


@query("pr_curve", PROB_R + """
SELECT round(tp * 1.0 / P, 6) AS recall, round(tp * 1.0 / (tp + fp), 6) AS precision, round(score, 6) AS threshold
FROM cu, tot WHERE tp - pos < P
UNION ALL SELECT 0.0, 1.0, NULL""")
def q_pr_curve(spark, sf):
    return rounded(evaluate.pr_curve(nb_scores(spark, sf), TARGET, "score", "R"))


@query("class_probabilities", NB_SQL + """
SELECT l_key, cls AS class, round(exp(jll - mj) / se, 6) AS probability FROM js""")
def q_class_probabilities(spark, sf):
    nb, p = nb_predictions(spark, sf)
    return rounded(evaluate.class_probabilities(p, "probability", nb.classes, "l_key"))


# ------------------------------------------------------------- regression

REG_SQL = """WITH co AS (SELECT regr_slope(p_retailprice, p_partkey) AS b, regr_intercept(p_retailprice, p_partkey) AS a FROM part),
pr AS (SELECT p_partkey, p_retailprice AS y, a + b * p_partkey AS yhat FROM part, co)"""


def linear_predictions(spark, sf):
    p = I.table(spark, sf, "part")
    m = SparkModel("reg_linear").fit(p, ["p_partkey"], "p_retailprice")
    return m, m.transform(p.select("p_partkey", "p_retailprice"))


@query("reg_linear", REG_SQL + "\nSELECT p_partkey, round(yhat, 4) AS prediction FROM pr")
def q_reg_linear(spark, sf):
    _, p = linear_predictions(spark, sf)
    return rounded(p.select("p_partkey", "prediction"), 4)


@query("metrics_regression", REG_SQL + """
SELECT round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 4) AS r2,
       round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse, round(avg(abs(y - yhat)), 4) AS mae,
       round(avg((y - yhat) * (y - yhat)), 4) AS mse FROM pr""")
def q_metrics_regression(spark, sf):
    _, p = linear_predictions(spark, sf)
    return rounded(evaluate.metrics_regression(p, "p_retailprice", "prediction"), 4)


@query("predictions_table_regression", REG_SQL + """
SELECT round(y, 4) AS Actual, round(yhat, 4) AS Predicted, round(abs(y - yhat), 4) AS "Absolute Error" FROM pr""")
def q_predictions_table_regression(spark, sf):
    _, p = linear_predictions(spark, sf)
    return rounded(evaluate.predictions_table(p, "p_retailprice", "prediction", "Regression"), 4)


@query("residuals", REG_SQL + "\nSELECT round(yhat, 4) AS fitted, round(y - yhat, 4) AS residual FROM pr")
def q_residuals(spark, sf):
    _, p = linear_predictions(spark, sf)
    return rounded(evaluate.residuals(p, "p_retailprice", "prediction"), 4)


@query("actual_vs_predicted", REG_SQL + """
SELECT round(LEAST(min(y), min(yhat)), 4) AS line_min, round(GREATEST(max(y), max(yhat)), 4) AS line_max FROM pr""")
def q_actual_vs_predicted(spark, sf):
    _, p = linear_predictions(spark, sf)
    return rounded(evaluate.actual_vs_predicted_line(p, "p_retailprice", "prediction"), 4)


# -------------------------------------------------------------- clustering

DIMS = 64  # fixed value: the length of the given embeddings
DIM_COLS = [f"x{i}" for i in range(DIMS)]
EMB_SQL = "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIMS)) + " FROM embeddings)"


def _dims(term: str) -> str:
    """``term`` with # for the number of the dimension, added up over all dimensions."""
    return " + ".join(term.replace("#", str(i)) for i in range(DIMS))


def _each(term: str) -> str:
    return ", ".join(term.replace("#", str(i)) for i in range(DIMS))


def embedding_columns(spark, sf):
    e = I.table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIM_COLS)], "label")


@query("metrics_clustering", f"""
WITH t AS {EMB_SQL},
g AS (SELECT {_each('avg(x#) AS g#')}, count(*) AS n, count(DISTINCT label) AS k FROM t),
c AS (SELECT label, count(*) AS nk, {_each('avg(x#) AS c#')}, {_each('sum(x#) AS s#')}, sum({_dims('x# * x#')}) AS q FROM t GROUP BY label),
intra AS (SELECT t.label, avg(sqrt({_dims('(x# - c#) * (x# - c#)')})) AS s FROM t JOIN c ON t.label = c.label GROUP BY t.label),
db AS (SELECT avg(mx) AS db FROM (SELECT a.label, max((ia.s + ib.s) / sqrt({_dims('(a.c# - b.c#) * (a.c# - b.c#)')})) AS mx
       FROM c a JOIN c b ON a.label <> b.label JOIN intra ia ON ia.label = a.label JOIN intra ib ON ib.label = b.label
       GROUP BY a.label)),
ch AS (SELECT sum(nk * ({_dims('(c# - g#) * (c# - g#)')})) AS bss FROM c, g),
wss AS (SELECT sum({_dims('(x# - c#) * (x# - c#)')}) AS wss FROM t JOIN c ON t.label = c.label),
d AS (SELECT t.vec_id, t.label AS own, c.label AS other, c.nk,
             ({_dims('x# * x#')}) - 2 * ({_dims('x# * s#')}) / c.nk + q / c.nk AS msq FROM t, c),
ab AS (SELECT vec_id, max(CASE WHEN own = other THEN CASE WHEN nk > 1 THEN msq * nk / (nk - 1) ELSE 0 END END) AS a,
              min(CASE WHEN own <> other THEN msq END) AS b, max(CASE WHEN own = other THEN nk END) AS own_n FROM d GROUP BY vec_id),
sil AS (SELECT avg(CASE WHEN own_n <= 1 OR a = b THEN 0 ELSE (b - a) / GREATEST(a, b) END) AS s FROM ab)
SELECT round(sil.s, 6) AS silhouette_squared, round(db.db, 6) AS davies_bouldin,
       round(ch.bss * (g.n - g.k) / (wss.wss * (g.k - 1)), 6) AS calinski_harabasz FROM sil, db, ch, wss, g""")
def q_metrics_clustering(spark, sf):
    return rounded(evaluate.metrics_clustering(embedding_columns(spark, sf), DIM_COLS, "label"))


@query("cluster_sizes", "SELECT label, CAST(count(*) AS BIGINT) AS count FROM embeddings GROUP BY label")
def q_cluster_sizes(spark, sf):
    return evaluate.cluster_sizes(I.table(spark, sf, "embeddings"), "label")


@query("cluster_kmeans")
def q_cluster_kmeans(spark, sf):
    """k-means (k = 10, 10 restarts from seed 42, lowest cost kept) on all dimensions."""
    e = embedding_columns(spark, sf)
    m = fit_kmeans(e, DIM_COLS, k=10, restarts=10)
    return kmeans_assign(m, e, DIM_COLS).select("vec_id", "Cluster")


@query("cluster_table")
def q_cluster_table(spark, sf):
    """The clustered table itself: every column of its input and the cluster, by a saved and reloaded model."""
    c = I.table(spark, sf, "customer")
    st = scale.fit_scaler(c, ["c_acctbal", "c_nationkey"], "standard")
    pipe = Pipeline().append(st, "standard scale")
    m = ClusterModel(k=4).fit(st.apply(c), ["c_acctbal", "c_nationkey"])
    path = scratch_path(spark, "clusters")
    io.save_model(m, pipe, path)
    again, _ = io.load_model(path)
    assigned = again.transform(st.apply(c)).select("c_custkey", "Cluster")
    return c.join(assigned, "c_custkey")


@query("cluster_pca_3d")
def q_cluster_pca_3d(spark, sf):
    """Clusters projected on 3 unstandardised principal components (labels travel as a column)."""
    x = embedding_columns(spark, sf).drop("label")
    m = fit_kmeans(x, DIM_COLS, k=5)
    assigned = kmeans_assign(m, x, DIM_COLS)
    st = transform.fit_pca(assigned, DIM_COLS, 3, standardize=False)
    return rounded(st.apply(assigned).select("vec_id", "Cluster", "PC_1", "PC_2", "PC_3"))


@query("pca_space_3d")
def q_pca_space_3d(spark, sf):
    li = I.lineitem_keyed(spark, sf)
    st = transform.fit_pca(li, LI_NUM, 3, standardize=False)
    return rounded(st.apply(li.select("l_key", TARGET, *LI_NUM)))


# ------------------------------------------------------ splits and labels

@query("split_random", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey)
                             <= CAST(ceil(0.2 * count(*) OVER ()) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM orders""")
def q_split_random(spark, sf):
    return sample.split_random(I.table(spark, sf, "orders"), "o_orderkey", 0.2, 42).select("o_orderkey", "split")


@query("split_stratified", """
WITH cc AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1),
tot AS (SELECT CAST(ceil(0.2 * sum(n)) AS BIGINT) AS nt FROM cc),
base AS (SELECT c, n, CAST(floor(0.2 * n) AS BIGINT) AS b, 0.2 * n - floor(0.2 * n) AS frac FROM cc),
ranked AS (SELECT *, row_number() OVER (ORDER BY frac DESC, n DESC, c) AS r FROM base),
alloc AS (SELECT c, b + CASE WHEN r <= (SELECT nt FROM tot) - (SELECT sum(b) FROM base) THEN 1 ELSE 0 END AS k FROM ranked)
SELECT o_orderkey, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split FROM (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
         ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) AS rn FROM orders) o JOIN alloc ON o.o_orderpriority = alloc.c""")
def q_split_stratified(spark, sf):
    out = sample.split_stratified(I.table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", 0.2, 42)
    return out.select("o_orderkey", "split")


@query("training_log", """
SELECT CAST(count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS BIGINT) AS train_samples,
       CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_samples FROM orders""")
def q_training_log(spark, sf):
    s = sample.split_random(I.table(spark, sf, "orders"), "o_orderkey", 0.2, 42)
    return s.agg(F.count_if(F.col("split") == "train").cast("long").alias("train_samples"),
                 F.count_if(F.col("split") == "test").cast("long").alias("test_samples"))


@query("target_encode_labels", """
SELECT l_returnflag AS class, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS index,
       CAST(count(*) AS BIGINT) AS count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def q_target_encode_labels(spark, sf):
    li = I.table(spark, sf, "lineitem")
    idx = encode.category_index(li.where(F.col(TARGET).isNotNull()), TARGET).withColumnRenamed("category", "class")
    counts = profile.class_distribution(li, TARGET)
    return idx.join(counts, "class")  # both one row per class


@query("validate_features", f"""
SELECT * FROM (
  SELECT 'l_quantity' AS column, CAST(count_if(l_quantity IS NULL OR isnan(l_quantity)) AS BIGINT) AS missing_count FROM {I.LQ_SQL} a
  UNION ALL SELECT 'l_extendedprice', CAST(count_if(l_extendedprice IS NULL) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'l_discount', CAST(count_if(l_discount IS NULL) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'l_tax', CAST(count_if(l_tax IS NULL) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'l_returnflag', CAST(count_if(l_returnflag IS NULL) AS BIGINT) FROM lineitem) WHERE missing_count > 0""")
def q_validate_features(spark, sf):
    from ..operators.validate import validate_features
    return validate_features(I.lineitem_nulls(spark, sf), LI_NUM, TARGET)


# the oracle's means are exact (integer cents, half-up division): means of these 2-decimal
# columns fall on 6th-place rounding ties, where any floating-point sum may land either side
@query("preset_rows", f"""
SELECT 'mean' AS preset, CAST((2 * sum(CAST(round(l_quantity * 100) AS BIGINT)) * 10000 + count(l_quantity)) // (2 * count(l_quantity)) AS DOUBLE) / 1000000 AS l_quantity, CAST((2 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 10000 + count(l_extendedprice)) // (2 * count(l_extendedprice)) AS DOUBLE) / 1000000 AS l_extendedprice, CAST((2 * sum(CAST(round(l_discount * 100) AS BIGINT)) * 10000 + count(l_discount)) // (2 * count(l_discount)) AS DOUBLE) / 1000000 AS l_discount, CAST((2 * sum(CAST(round(l_tax * 100) AS BIGINT)) * 10000 + count(l_tax)) // (2 * count(l_tax)) AS DOUBLE) / 1000000 AS l_tax, min(l_linestatus) AS l_linestatus
FROM {I.LQ_SQL} a
UNION ALL
SELECT 'min', round(min(l_quantity), 6), round(min(l_extendedprice), 6), round(min(l_discount), 6), round(min(l_tax), 6),
       min(l_linestatus) FROM {I.LQ_SQL} b
UNION ALL
SELECT 'median', round(median(l_quantity), 6), round(median(l_extendedprice), 6), round(median(l_discount), 6),
       round(median(l_tax), 6), min(l_linestatus) FROM {I.LQ_SQL} c""")
def q_preset_rows(spark, sf):
    from ..operators.validate import preset_rows
    t = I.lineitem_nulls(spark, sf).select(*LI_NUM, "l_linestatus")
    return rounded(preset_rows(profile.raw_profile(t), spark, ["mean", "min", "median"]))


# ------------------------------------------------------- model menu (P)

def _clf_data(spark, sf):
    li = I.lineitem_keyed(spark, sf)
    split = I.kept(sample.split_random(li, ["l_key"], 0.2, 42))
    return sample.train_test(split)


def _clf_query(kind, params):
    def fn(spark, sf):
        train, test = _clf_data(spark, sf)
        m = SparkModel(kind, params).fit(train, LI_NUM, TARGET)
        return m.transform(test.select("l_key", TARGET, *LI_NUM)).select("l_key", TARGET, "prediction")
    fn.__doc__ = f"{kind} fitted on the hash-split train rows, predictions for the test rows."
    return fn


for _kind, _params in [("clf_random_forest", {"n_estimators": 100, "max_depth": 12}),
                       ("clf_decision_tree", {"max_depth": 10}),
                       ("clf_logistic", {"C": 1.0, "max_iter": 100}),
                       ("clf_svm", {"C": 1.0}),
                       ("clf_mlp", {"hidden": 100, "max_iter": 200}),
                       ("clf_gbt", {"n_estimators": 100, "learning_rate": 0.1})]:
    query(_kind)(_clf_query(_kind, _params))


def _reg_query(kind, params):
    def fn(spark, sf):
        p = I.table(spark, sf, "part")
        split = sample.split_random(p, ["p_partkey"], 0.2, 42)
        train, test = sample.train_test(split)
        m = SparkModel(kind, params).fit(train, ["p_partkey", "p_size"], "p_retailprice")
        return rounded(m.transform(test.select("p_partkey", "p_size", "p_retailprice"))
                       .select("p_partkey", "p_retailprice", "prediction"), 4)
    fn.__doc__ = f"{kind} on part: p_retailprice from p_partkey and p_size, test-row predictions."
    return fn


for _kind, _params in [("reg_random_forest", {"n_estimators": 100, "max_depth": 12}),
                       ("reg_decision_tree", {"max_depth": 10}),
                       ("reg_ridge", {"alpha": 1.0}),
                       ("reg_lasso", {"alpha": 0.1}),
                       ("reg_gbt", {"n_estimators": 100, "learning_rate": 0.1})]:
    query(_kind)(_reg_query(_kind, _params))


@query("feature_importance")
def q_feature_importance(spark, sf):
    train, _ = _clf_data(spark, sf)
    m = SparkModel("clf_random_forest", {"n_estimators": 100, "max_depth": 12}).fit(train, LI_NUM, TARGET)
    return rounded(m.feature_importance(spark))


@query("model_params")
def q_model_params(spark, sf):
    train, _ = _clf_data(spark, sf)
    m = SparkModel("clf_decision_tree", {"max_depth": 50}).fit(train, LI_NUM, TARGET)
    return m.param_table(spark)


@query("rfe_select")
def q_rfe_select(spark, sf):
    from ..operators.select import rfe_select
    li = I.lineitem_keyed(spark, sf)
    kept = rfe_select(li, LI_NUM, TARGET, 2, "Classification")
    return spark.createDataFrame([(c,) for c in kept], "feature string")


# ---------------------------------------------------- sources and sinks

@query("read_csv", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_read_csv(spark, sf):
    path = scratch_path(spark, "customer-csv")
    io.write_csv(I.table(spark, sf, "customer"), path)
    return io.read_csv(spark, path)


@query("write_csv", "SELECT * FROM part")
def q_write_csv(spark, sf):
    p = I.table(spark, sf, "part")
    path = scratch_path(spark, "part-csv")
    io.write_csv(p, path)
    return io.read_csv(spark, path, schema=p.schema)


@query("write_predictions", SCORE_SQL + """
SELECT l_key, l_returnflag, cls AS Predicted_l_returnflag, round(1.0 / se, 6) AS Confidence,
       l_returnflag = cls AS Accurate FROM js WHERE rk = 1""")
def q_write_predictions(spark, sf):
    """The scored test rows written as CSV to the shared folder and read back."""
    _p, _nb, scored = flagship_scored(spark, sf)
    path = scratch_path(spark, "predictions-csv")
    io.write_csv(scored, path)
    return rounded(io.read_csv(spark, path, schema=scored.schema))


@query("write_metrics_json", BATCH_METRICS_SQL + f"""SELECT 'lineitem' AS dataset, 'gaussian_nb' AS model, 'Classification' AS problem_type,
'l_returnflag' AS target, 4 AS steps, 'impute median l_quantity' AS first_step, '1e-09' AS var_smoothing, {BATCH_METRICS} FROM m""")
def q_write_metrics_json(spark, sf):
    """The report written as JSON and read back."""
    pipe, _nb, scored = flagship_scored(spark, sf)
    metrics = score_batch_metrics(scored, TARGET)
    path = scratch_path(spark, "report-json")
    io.write_metrics_json(spark, path, dataset="lineitem", model="gaussian_nb", problem_type="Classification",
                          target=TARGET, metrics=metrics, log=pipe.log, hyperparameters={"var_smoothing": 1e-9})
    back = spark.read.json(path)
    return rounded(back.select("dataset", "model", "problem_type", "target", F.size("log").alias("steps"), F.col("log")[0]["entry"].alias("first_step"),
                               "hyperparameters.var_smoothing", "metrics.*"))


@query("save_load_model", f"""WITH {_split_sql(I.LK_SQL + " src", "l_key").lstrip()} SELECT l_key, TRUE AS same FROM test_rows""")
def q_save_load_model(spark, sf):
    """A fitted model and the pipeline it was fitted behind saved together, loaded back, scores identical."""
    train, test = _clf_data(spark, sf)
    pipe = Pipeline().init_from_raw(train.drop("l_key"), target=TARGET)
    df = pipe.fit_step(train, encode.fit_index(train, ["l_linestatus"], "label"), "label l_linestatus")
    df = pipe.fit_step(df, scale.fit_scaler(df, LI_NUM, "standard"), "standard scale")
    features = [*LI_NUM, "l_linestatus"]
    pipe.set_features(features)
    m = SparkModel("clf_decision_tree", {"max_depth": 10}).fit(df, features, TARGET)
    path = scratch_path(spark, "model")
    io.save_model(m, pipe, path)
    m2, pipe2 = io.load_model(path)
    a, b = (x.transform(p.transform(test, keep=["l_key"])).select("l_key", F.col("prediction").alias(n)) for x, p, n in ((m, pipe, "p1"), (m2, pipe2, "p2")))
    return a.join(b, "l_key").select("l_key", (F.col("p1") == F.col("p2")).alias("same"))


def _audit_sql():
    feats = ", ".join(FLAG_FEATURES)
    prof = lambda section, src, k, miss: f"""
SELECT '{section}' AS section, key, value FROM (
  SELECT CAST(count(*) AS VARCHAR) AS rows, '{k}' AS cols, CAST({miss} AS VARCHAR) AS missing_count,
         CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src} d)) AS VARCHAR) AS duplicate_count,
         CAST(GREATEST(10, LEAST(100, 100
           - CASE WHEN {miss} > 0 THEN LEAST(35, CAST(floor({miss} * 100.0 / (count(*) * {k}) * 1.5) AS INTEGER)) ELSE 0 END
           - CASE WHEN count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM {src} d))
                  THEN LEAST(25, CAST(floor((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src} d)))
                                      * 100.0 / count(*) * 1.2) AS INTEGER)) ELSE 0 END)) AS VARCHAR) AS health_score
  FROM {src} s) UNPIVOT (value FOR key IN (rows, cols, missing_count, duplicate_count, health_score))"""
    return (SCORE_SQL + f""",
lq AS {I.LQ_SQL},
after_t AS (SELECT l_returnflag,  -- prep covers train + test = every raw row
 {', '.join(LI_NUM)}, l_linestatus_F, l_linestatus_O FROM prep),
pc AS (SELECT l_returnflag AS y, cls AS p, count(*) AS n FROM js WHERE rk = 1 GROUP BY 1, 2),
pcls AS (SELECT c AS cls, sum(tp) AS tp, sum(sup) AS sup, sum(pr) AS pr FROM (
    SELECT y AS c, CASE WHEN y = p THEN n ELSE 0 END AS tp, n AS sup, 0 AS pr FROM pc
    UNION ALL SELECT p, 0, 0, n FROM pc) GROUP BY c),
m AS (SELECT *, CASE WHEN pr > 0 THEN tp * 1.0 / pr ELSE 0 END AS prec, CASE WHEN sup > 0 THEN tp * 1.0 / sup ELSE 0 END AS rec FROM pcls),
mt AS (SELECT round(sum(tp) * 1.0 / sum(sup), 6) AS accuracy, round(sum(prec * sup) / sum(sup), 6) AS precision,
       round(sum(rec * sup) / sum(sup), 6) AS recall,
       round(sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * sup) / sum(sup), 6) AS f1 FROM m)
""" + prof("before", "lq", 11, "count_if(l_quantity IS NULL)") + "\nUNION ALL" + prof("after", "after_t", 7, "0") + """
UNION ALL SELECT 'log', '001', 'impute median l_quantity'
UNION ALL SELECT 'log', '002', 'clip IQR'
UNION ALL SELECT 'log', '003', 'one-hot l_linestatus'
UNION ALL SELECT 'log', '004', 'standard scale'
UNION ALL SELECT 'model', 'name', 'gaussian_nb'
UNION ALL SELECT 'model', 'target', 'l_returnflag'
UNION ALL SELECT 'metrics', key, CAST(value AS VARCHAR) FROM mt UNPIVOT (value FOR key IN (accuracy, precision, recall, f1))""")


@query("audit_report", _audit_sql())
def q_audit_report(spark, sf):
    from ..operators.report import audit_table
    pipe, _nb, scored = flagship_scored(spark, sf)
    before = I.lineitem_nulls(spark, sf)
    after = pipe.transform(before, keep=[TARGET])
    return audit_table(before, after, pipe, score_batch_metrics(scored, TARGET), model="gaussian_nb", target=TARGET)



# ------------------------------------------------- isolation forest, samples

@query("outlier_isolation_forest")
def q_outlier_isolation_forest(spark, sf):
    """Rows left after removing the 5% most isolated (100 trees of 256 rows, seed 42)."""
    from ..operators.iforest import isolation_forest_outliers
    li = I.lineitem_keyed(spark, sf)
    kept, _model = isolation_forest_outliers(li, LI_NUM, ["l_key"], action="remove", contamination=0.05)
    return kept.select("l_key")


@query("sample_table", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
       l_shipdate, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END
       AS return_status FROM lineitem""")
def q_sample_table(spark, sf):
    from ..sources.samples import sample_table
    return sample_table(spark, sf, "lineitem_returns")


INSPECT_ROW = 123

INSPECT_SQL = f"""WITH raw AS {LQK_SQL}, {_split_sql('raw', 'l_key')},
picked AS (SELECT * FROM (SELECT * FROM {LQK_SQL} r LIMIT 1 OFFSET {INSPECT_ROW})),
both_rows AS (SELECT *, 'train' AS part FROM train_rows UNION ALL SELECT *, 'pick' AS part FROM picked),
{_flagship_prep_sql('train_rows', 'both_rows', ', part')},
prep_tr AS (SELECT * FROM prep WHERE part = 'train'), prep_te AS (SELECT * FROM prep WHERE part = 'pick'),
{_nb_sql('prep_tr', 'prep_te', FLAG_FEATURES, TARGET, 'l_key')}
SELECT l_key, {', '.join(f'round({c}, 6) AS {c}' for c in LI_NUM)}, l_linestatus_F, l_linestatus_O,
       l_returnflag AS actual, cls AS predicted, l_returnflag = cls AS match FROM js WHERE rk = 1"""


@query("inspect_row", INSPECT_SQL)
def q_inspect_row(spark, sf):
    """Row 123 of the raw file (file order): its replayed features, actual, prediction, match."""
    from ..sources.io import with_row_id
    from ..session import table_path
    pipe, nb, _scored = flagship_scored(spark, sf)
    raw = I.add_lineitem_key_and_nulls(with_row_id(spark.read.parquet(table_path(sf, "lineitem"))))
    row = raw.where(F.col("_row_id") == INSPECT_ROW).drop("_row_id")
    feats = pipe.transform(row, keep=["l_key", TARGET])
    out = nb.transform(feats)
    return rounded(out.select("l_key", *FLAG_FEATURES, F.col(TARGET).alias("actual"), F.col("prediction").alias("predicted"),
                              (F.col(TARGET) == F.col("prediction")).alias("match")))


# ------------------------------------------------------------ kernel SVM / SVR

def _kernel_svc_query(kernel):
    def fn(spark, sf):
        from ..models.kernel_svm import KernelSVC
        train, test = _clf_data(spark, sf)
        m = KernelSVC(kernel=kernel, C_=1.0, n_components=100, max_iter=50).fit(train, LI_NUM, TARGET)
        return m.transform(test.select("l_key", TARGET, *LI_NUM)).select("l_key", TARGET, "prediction")
    fn.__doc__ = f"SVC with the {kernel} kernel (explicit feature map + LinearSVC, one-vs-rest)."
    return fn


for _k in ["rbf", "poly"]:
    query(f"clf_svm_{_k}")(_kernel_svc_query(_k))


@query("reg_svr")
def q_reg_svr(spark, sf):
    """epsilon-SVR (rbf map) on part: p_retailprice from p_partkey and p_size."""
    from ..models.kernel_svm import KernelSVR
    from ..operators.scale import fit_scaler
    p = I.table(spark, sf, "part")
    split = sample.split_random(p, ["p_partkey"], 0.2, 42)
    train, test = sample.train_test(split)
    st = fit_scaler(train, ["p_partkey", "p_size"], "standard")
    m = KernelSVR(kernel="rbf", C_=10.0, epsilon=1.0).fit(
        st.apply(train), ["p_partkey", "p_size"], "p_retailprice")
    out = m.transform(st.apply(test.select("p_partkey", "p_size", "p_retailprice").withColumn("key", F.col("p_partkey"))))
    return rounded(out.select(F.col("key").alias("p_partkey"), "p_retailprice", "prediction"), 4)


@query("impute_iterative_features")
def q_impute_iterative_features(spark, sf):
    """Chained-equation imputation of l_quantity (NULL rule) from the other numeric columns."""
    from ..operators.mice import fit_mice
    li = I.lineitem_keyed_nulls(spark, sf)
    st = fit_mice(li, LI_NUM, max_iter=10)
    return rounded(st.apply(li).select("l_key", *LI_NUM))


@query("pr_auc", PROB_R + """
SELECT round(sum((tp * 1.0 / P - (tp - pos) * 1.0 / P)
                 * (tp * 1.0 / (tp + fp) + CASE WHEN (tp - pos) + (fp - neg) > 0
                                                THEN (tp - pos) * 1.0 / ((tp - pos) + (fp - neg)) ELSE 1.0 END) / 2.0), 6)
       AS pr_auc FROM cu, tot WHERE tp - pos < P""")
def q_pr_auc(spark, sf):
    """Area under the precision-recall points (trapezoids, from the (recall 0, precision 1) end)."""
    return rounded(evaluate.pr_auc(nb_scores(spark, sf), TARGET, "score", "R"))


@query("box_outliers", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events GROUP BY event_type)
SELECT e.event_type, e.value FROM events e JOIN q ON e.event_type = q.event_type
WHERE e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1)""")
def q_box_outliers(spark, sf):
    from ..operators import charts
    ev = I.table(spark, sf, "events")
    box = charts.box_stats(ev, "value", "event_type")
    return charts.box_outliers(ev, "value", box, "event_type")
