"""Evaluation tables: classification / regression / clustering metrics and curves.

Classification metrics all derive from one ``groupBy(label, prediction).count()``.
ROC and PR curves group by score first, then use exact distributed prefix sums
(``running_totals``): no window without a partition key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import number
from ..functions.order_stats import running_totals
from ..session import written

#: Classes whose grid of pairs is made.
MAX_CLASSES = 1000


def _pair_counts(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    return (pred.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))


def _per_class(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """class, tp, support, predicted (over the union of true and predicted labels)."""
    pc = _pair_counts(pred, label, prediction)
    true_c = pc.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"),
                                                     F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    pred_c = pc.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = true_c.join(pred_c, "cls", "full")
    return j.select("cls", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
                    F.coalesce("predicted", F.lit(0)).alias("predicted"))


def _prf(t: DataFrame) -> DataFrame:
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.withColumn("f1", f1)


def metrics_classification(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy; precision, recall, F1 averaged with support weights; 0 on zero division."""
    t = _prf(_per_class(pred, label, prediction))
    tot = F.sum("support")
    return t.agg((F.sum("tp") / tot).alias("accuracy"),
                 (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                 (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          places: int = 4) -> DataFrame:
    """Per class (true or predicted) precision / recall / F1 / support, then accuracy, macro avg, weighted avg rows."""
    t = _prf(_per_class(pred, label, prediction))
    per = t.select(F.col("cls").alias("row"), "precision", "recall", "f1",
                                               F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    acc = t.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"), (F.sum("tp") / tot).alias("f1"),
                tot.cast("long").alias("support"))
    macro = t.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("long").alias("support"))
    weighted = t.agg(F.lit("weighted avg").alias("row"),
                     (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                     (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.cast("long").alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("row", *[F.round(c, places).alias(c) for c in ["precision", "recall", "f1"]], "support")


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction", labels: str = "both") -> DataFrame:
    """Long form (actual, predicted, count) over the full grid of labels: those seen in either column, or with
    ``labels="actual"`` in the label column only, which leaves out predictions of other classes."""
    pc = _pair_counts(pred, label, prediction)
    seen = pc.select("y") if labels == "actual" else pc.select("y").union(pc.select("p"))
    found = seen.where(F.col("y").isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    # the label set is the class list (bounded); the full grid is built from it as literals
    lab = F.array(*[F.lit(v) for v in sorted(r[0] for r in found)])
    grid = pred.sparkSession.range(1).select(F.explode(lab).alias("actual")).select(
        "actual", F.explode(lab).alias("predicted"))
    return (grid.join(pc, (grid.actual == pc.y) & (grid.predicted == pc.p), "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("count")))


def metrics_regression(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R^2, RMSE, MAE, MSE in one aggregate, over rows that have both numbers."""
    e = number(label) - number(prediction)
    a = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
                 F.var_pop(F.when(e.isNotNull(), number(label))).alias("vy"), F.count(e).alias("n"))
    r2 = F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("vy") * F.col("n"))).otherwise(F.lit(0.0))
    return a.select(r2.alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mse")


def _score_counts(pred: DataFrame, label: str, score: str, pos_label) -> DataFrame:
    """(score, pos, neg) per distinct score, written because the curve makes several passes over it."""
    y = (F.col(label).cast("string") == F.lit(str(pos_label))).cast("long")
    counts = pred.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return written(counts, "curve-scores")


def roc_curve(pred: DataFrame, label: str, score: str, pos_label, drop_intermediate: bool = True) -> DataFrame:
    """Points (fpr, tpr, threshold) for one positive class, from the highest score down,
    starting at (0, 0, +inf). With ``drop_intermediate`` collinear points (same step as the
    next point) are dropped. Exact prefix sums, no single-task window."""
    sc = _score_counts(pred, label, score, pos_label)
    P, N = _totals(sc)
    pts = running_totals(sc, "score", ["pos", "neg"], descending=True, n_rows=P + N)
    if drop_intermediate:
        pts = _keep_turning_points(pts)
    start = pred.sparkSession.createDataFrame([(0.0, 0.0, float("inf"))], "fpr double, tpr double, threshold double")
    body = pts.select((F.col("cum_neg") / F.lit(float(N))).alias("fpr"), (F.col("cum_pos") / F.lit(float(P))).alias("tpr"),
                      F.col("score").alias("threshold"))
    return start.unionByName(body)


def _totals(sc: DataFrame):
    r = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()[0]
    return (r["P"] or 0), (r["N"] or 0)


def _keep_turning_points(pts: DataFrame, group: str | None = None) -> DataFrame:
    """Keep point i when its (pos, neg) step differs from point i+1's, plus first and last.
    The next row's step comes from a within-bucket lead; a bucket's last row looks at the
    first row of the next non-empty bucket (one small row per group and bucket)."""
    pts = pts.withColumn("__of", F.col(group) if group else F.lit(0))
    w = Window.partitionBy("__of", "__bucket").orderBy(F.desc("score"))
    firsts = pts.groupBy("__of", "__bucket").agg(F.max_by(F.struct("pos", "neg"), F.col("score")).alias("f"))
    wb = Window.partitionBy("__of").orderBy("__bucket")
    link = firsts.select("__of", F.lag("__bucket").over(wb).alias("__bucket"), F.col("f.pos").alias("__npos"), F.col("f.neg").alias("__nneg"))
    p = (pts.withColumn("__lpos", F.lead("pos").over(w)).withColumn("__lneg", F.lead("neg").over(w))
         .join(F.broadcast(link.where(F.col("__bucket").isNotNull())), ["__of", "__bucket"], "left"))
    npos = F.coalesce(F.col("__lpos"), F.col("__npos"))
    nneg = F.coalesce(F.col("__lneg"), F.col("__nneg"))
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    keep = npos.isNull() | first | (npos != F.col("pos")) | (nneg != F.col("neg"))
    return p.where(keep).drop("__of")


def _class_counts(pred: DataFrame, label: str, probability: str, classes: list) -> tuple[DataFrame, DataFrame]:
    """Of each class against the rest: (class, score, pos, neg) per distinct score, written, and the totals
    (class, P, N) of the classes that have rows of both kinds."""
    each = F.arrays_zip(F.array(*[F.lit(str(c)) for c in classes]).alias("class"), F.col(probability).alias("score"))
    rows = pred.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y"), F.explode(each).alias("s"))
    y = (F.col("y") == F.col("class")).cast("long")
    counts = rows.select("y", "s.class", F.col("s.score").cast("double").alias("score")).groupBy("class", "score").agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    counts = written(counts, "curve-scores")
    totals = counts.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).where("P > 0 and N > 0")
    return counts.join(F.broadcast(totals.select("class")), "class", "left_semi"), totals  # a row for each class


def roc_curves(pred: DataFrame, label: str, probability: str, classes: list, drop_intermediate: bool = True) -> DataFrame:
    """One-vs-rest points (class, fpr, tpr, threshold) of every class, as ``roc_curve`` gives them; a class
    without rows, or without rows of others, has none. ``probability``: an array in the order of ``classes``."""
    counts, totals = _class_counts(pred, label, probability, classes)
    pts = running_totals(counts, "score", ["pos", "neg"], descending=True, group="class")
    if drop_intermediate:
        pts = _keep_turning_points(pts, "class")
    body = pts.join(F.broadcast(totals), "class").select("class", (F.col("cum_neg") / F.col("N")).alias("fpr"), (F.col("cum_pos") / F.col("P")).alias("tpr"),
                                                         F.col("score").alias("threshold"))
    start = totals.select("class", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return start.unionByName(body)


def roc_aucs(pred: DataFrame, label: str, probability: str, classes: list) -> DataFrame:
    """(class, auc) of every class against the rest."""
    counts, totals = _class_counts(pred, label, probability, classes)
    cum = running_totals(counts, "score", ["pos", "neg"], descending=True, group="class")
    area = F.sum(F.col("neg").cast("double") * (2.0 * F.col("cum_pos") - F.col("pos")))
    area = cum.groupBy("class").agg(area.alias("area")).join(F.broadcast(totals), "class")
    return area.select("class", (F.col("area") / (2.0 * F.col("P").cast("double") * F.col("N"))).alias("auc"))


def pr_curves(pred: DataFrame, label: str, probability: str, classes: list) -> DataFrame:
    """One-vs-rest points (class, recall, precision, threshold) of every class, as ``pr_curve`` gives them."""
    counts, totals = _class_counts(pred, label, probability, classes)
    cum = running_totals(counts, "score", ["pos", "neg"], descending=True, group="class").join(F.broadcast(totals), "class")
    pts = cum.where(F.col("cum_pos") - F.col("pos") < F.col("P"))
    body = pts.select("class", (F.col("cum_pos") / F.col("P")).alias("recall"), (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                      F.col("score").alias("threshold"))
    end = totals.select("class", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"))
    return body.unionByName(end)


def roc_auc(pred: DataFrame, label: str, score: str, pos_label) -> DataFrame:
    """Area under the ROC curve: sum over score groups of neg * (2 * cum_pos - pos) / (2 P N)."""
    sc = _score_counts(pred, label, score, pos_label)
    P, N = _totals(sc)
    cum = running_totals(sc, "score", ["pos", "neg"], descending=True, n_rows=P + N)
    return cum.agg((F.sum(F.col("neg").cast("double") * (2.0 * F.col("cum_pos") - F.col("pos")))
                    / (2.0 * F.sum(F.col("pos").cast("double")) * F.sum(F.col("neg").cast("double")))).alias("auc"))


def pr_curve(pred: DataFrame, label: str, score: str, pos_label) -> DataFrame:
    """(recall, precision, threshold) from the highest score down to the first threshold with full
    recall, then the (recall 0, precision 1) end point (threshold NULL)."""
    sc = _score_counts(pred, label, score, pos_label)
    P, _N = _totals(sc)
    cum = running_totals(sc, "score", ["pos", "neg"], descending=True, n_rows=P + _N)
    pts = cum.where(F.col("cum_pos") - F.col("pos") < F.lit(P))
    prec = F.when(F.col("cum_pos") + F.col("cum_neg") > 0, F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).otherwise(0.0)
    rec = F.col("cum_pos") / F.lit(float(P)) if P > 0 else F.lit(float("nan"))
    body = pts.select(rec.alias("recall"), prec.alias("precision"), F.col("score").alias("threshold"))
    end = pred.sparkSession.createDataFrame([(0.0, 1.0, None)], "recall double, precision double, threshold double")
    return body.unionByName(end)


def pr_auc(pred: DataFrame, label: str, score: str, pos_label) -> DataFrame:
    """Trapezoid area under the PR points above (including the end point)."""
    sc = _score_counts(pred, label, score, pos_label)
    P, _N = _totals(sc)
    cum = running_totals(sc, "score", ["pos", "neg"], descending=True, n_rows=P + _N)
    pts = cum.where(F.col("cum_pos") - F.col("pos") < F.lit(P))
    rec = F.col("cum_pos") / F.lit(float(P))
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    prev_tp = F.col("cum_pos") - F.col("pos")
    prev_fp = F.col("cum_neg") - F.col("neg")
    prev_rec = prev_tp / F.lit(float(P))
    prev_prec = F.when(prev_tp + prev_fp > 0, prev_tp / (prev_tp + prev_fp)).otherwise(F.lit(1.0))
    return pts.agg(F.sum((rec - prev_rec) * (prec + prev_prec) / 2.0).alias("pr_auc"))


def predictions_table(pred: DataFrame, label: str, prediction: str, problem: str = "Classification") -> DataFrame:
    if problem == "Classification":
        return pred.select(F.col(label).alias("Actual"), F.col(prediction).alias("Predicted"),
                           (F.col(label).cast("string") == F.col(prediction).cast("string")).alias("Accurate"))
    return pred.select(F.col(label).cast("double").alias("Actual"), F.col(prediction).cast("double").alias("Predicted"),
                       F.abs(F.col(label).cast("double") - F.col(prediction).cast("double")).alias("Absolute Error"))


def residuals(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    return pred.select(F.col(prediction).cast("double").alias("fitted"),
                       (F.col(label).cast("double") - F.col(prediction).cast("double")).alias("residual"))


def actual_vs_predicted_line(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Ends of the 1:1 line: min and max over both columns."""
    a, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return pred.agg(F.least(F.min(a), F.min(p)).alias("line_min"), F.greatest(F.max(a), F.max(p)).alias("line_max"))


def class_probabilities(pred: DataFrame, probability: str, classes: list, key: str) -> DataFrame:
    """(key, class, probability) per row; the caller sorts (a table has no order of its own)."""
    names = F.array(*[F.lit(str(c)) for c in classes])
    return (pred.select(key, F.posexplode(F.col(probability)).alias("i", "probability"))
            .select(key, F.element_at(names, F.col("i") + 1).alias("class"), "probability"))


def cluster_sizes(pred: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return pred.groupBy(cluster).agg(F.count(F.lit(1)).cast("long").alias("count"))


def metrics_clustering(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """Davies-Bouldin, Calinski-Harabasz (Euclidean) and the squared-Euclidean silhouette, all
    from per-cluster sums (no pair of rows is ever formed). 0 unless 2 <= clusters < n.

    Silhouette: for a point, the mean squared distance to cluster C is
    ||x||^2 - 2 x.S_C / n_C + Q_C / n_C, with S_C the feature sum and Q_C the sum of squared
    norms of C; a(x) uses n_C - 1 for its own cluster (the point itself adds 0)."""
    x = [F.col(c).cast("double") for c in features]
    sq = sum((v * v for v in x), F.lit(0.0))
    cl = df.groupBy(F.col(cluster).alias("k")).agg(
        F.count(F.lit(1)).alias("nk"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        F.sum(sq).alias("q")).collect()
    n = sum(r["nk"] for r in cl)
    K = len(cl)
    spark = df.sparkSession
    if not (2 <= K < n):
        return spark.createDataFrame([(0.0, 0.0, 0.0)], "silhouette_squared double, davies_bouldin double, calinski_harabasz double")
    d = len(features)
    cent = {r["k"]: [r[f"s{i}"] / r["nk"] for i in range(d)] for r in cl}
    size = {r["k"]: r["nk"] for r in cl}
    ssum = {r["k"]: [r[f"s{i}"] for i in range(d)] for r in cl}
    qsum = {r["k"]: r["q"] for r in cl}
    gmean = [sum(ssum[k][i] for k in size) / n for i in range(d)]
    # Calinski-Harabasz
    between = sum(size[k] * sum((cent[k][i] - gmean[i]) ** 2 for i in range(d)) for k in size)
    within_sq = sum(qsum[k] - size[k] * sum(c * c for c in cent[k]) for k in size)
    ch = 0.0 if within_sq == 0 else between * (n - K) / (within_sq * (K - 1))
    # Davies-Bouldin: needs the mean Euclidean distance to the centroid per cluster
    keys = sorted(size)
    cent_lit = F.create_map(*[v for k in keys for v in (F.lit(k), F.array(*[F.lit(float(c)) for c in cent[k]]))])
    dist = F.sqrt(sum(((x[i] - F.element_at(cent_lit[F.col(cluster)], i + 1)) ** 2 for i in range(d)), F.lit(0.0)))
    intra = {r["k"]: r["s"] for r in df.groupBy(F.col(cluster).alias("k")).agg(F.avg(dist).alias("s")).collect()}
    db_terms = []
    for a in keys:
        best = 0.0
        for b in keys:
            if a == b:
                continue
            m = sum((cent[a][i] - cent[b][i]) ** 2 for i in range(d)) ** 0.5
            val = float("inf") if m == 0 else (intra[a] + intra[b]) / m
            best = max(best, val)
        db_terms.append(best)
    db = sum(db_terms) / K
    # squared-Euclidean silhouette from the per-cluster sums: an array of K mean squared
    # distances per row (linear-size expression), own cluster picked by index
    msq = []
    for k in keys:
        dot_k = sum((x[i] * F.lit(float(ssum[k][i])) for i in range(d)), F.lit(0.0))
        msq.append(sq - 2.0 * dot_k / size[k] + F.lit(qsum[k] / size[k]))
    pos = F.create_map(*[v for j, k in enumerate(keys) for v in (F.lit(k), F.lit(j))])[F.col(cluster)]
    sizes = F.array(*[F.lit(size[k]) for k in keys])
    pts = df.select(F.array(*msq).alias("__m"), pos.alias("__p"))
    own_n = F.element_at(sizes, F.col("__p") + 1)
    own_m = F.element_at(F.col("__m"), F.col("__p") + 1)
    a = F.when(own_n > 1, own_m * own_n / (own_n - 1)).otherwise(F.lit(0.0))
    b = F.array_min(F.transform(F.col("__m"), lambda v, i: F.when(i == F.col("__p"), F.lit(None)).otherwise(v)))
    pts = pts.select(a.alias("__a"), b.alias("__b"), own_n.alias("__n"))
    sil_pt = F.when((F.col("__n") <= 1) | (F.col("__a") == F.col("__b")), F.lit(0.0)).otherwise(
        (F.col("__b") - F.col("__a")) / F.greatest(F.col("__a"), F.col("__b")))
    sil = pts.agg(F.avg(sil_pt).alias("s")).collect()[0]["s"]
    return spark.createDataFrame([(float(sil), float(db), float(ch))],
                                 "silhouette_squared double, davies_bouldin double, calinski_harabasz double")
