"""Dictionaries, bounded distinct counts, moments, lambda search, kernel models, calibration, curves of all
classes, validation before scoring and saving, on small tables with NaN, NULL and many categories."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.functions import dictionary, gram, sums
from tabforge.functions.distinct import distinct_counts, distinct_up_to
from tabforge.models.calibration import fit_calibration, probabilities
from tabforge.models.kernel_svm import KernelSVC, KernelSVR
from tabforge.models.knn import NeighborModel
from tabforge.models.naive_bayes import GaussianNB
from tabforge.models.spark_ml import ClusterModel, SparkModel
from tabforge.operators import charts, encode, evaluate, profile, transform
from tabforge.operators.validate import preset_rows
from tabforge.plans.pipeline import Pipeline, score_batch
from tabforge.sources import io

NAN = float("nan")


# ------------------------------------------------------------ dictionaries


def test_dictionary_of_many_categories_is_saved_and_scores_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dictionary, "ROWS_PER_PART", 4000)  # several ranges
    n = 25_000
    d = spark.range(n).select((F.col("id") * 1.0).alias("x"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("c"), (F.col("id") % 2).alias("y"))
    stages = [encode.fit_index(d, ["c"], "label"), encode.fit_index(d, ["c"], "ordinal"), encode.fit_frequency(d, ["c"])]
    want = {k: i for i, k in enumerate(sorted("é" + str(i) for i in range(n)))}
    got = stages[0].apply(d).collect()
    assert all(r.c == want["é" + str(int(r.x))] for r in got)
    pipe = Pipeline()
    for s in stages[:1]:
        pipe.append(s)
    model = SparkModel("clf_decision_tree", {"max_depth": 3}).fit(stages[0].apply(d), ["x", "c"], "y")
    path = f"file://{tmp_path}/m"
    io.save_model(model, pipe, path)
    again, loaded = io.load_model(path)
    assert loaded.stages[0].params["table"].startswith(path)
    a, b = (m.transform(p.stages[0].apply(d)).select("x", "prediction") for m, p in ((model, pipe), (again, loaded)))
    assert a.exceptAll(b).isEmpty()
    assert stages[2].apply(d.limit(3)).select("c").distinct().collect()[0].c == pytest.approx(1 / n)
    unseen = spark.createDataFrame([(0.0, "no", 1), (1.0, None, 1)], "x double, c string, y int")
    assert [r.c for r in stages[0].apply(unseen).collect()] == [-1, -1]
    assert [r.c for r in stages[2].apply(unseen).collect()] == [0.0, 0.0]
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", 0)  # joined by shuffle: the same codes
    assert sorted(r.c for r in stages[0].apply(d).collect()) == list(range(n))


def test_distinct_up_to(spark):
    d = spark.range(5000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"), F.when(F.col("id") < 2, "x").alias("c"),
                                 F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("d"), F.lit(None).cast("string").alias("e"),
                                 (F.col("id") % 11).cast("decimal(5,1)").alias("f"), F.array(F.col("id") % 2).alias("g"))
    assert distinct_up_to(d, d.columns, 10) == {"a": 3, "b": 11, "c": 1, "d": 1, "e": 0, "f": 11, "g": 2}
    exact = {r.column: r.n_distinct for r in distinct_counts(d.drop("g", "d"), ["a", "b", "c", "e"]).collect()}
    assert exact == {"a": 3, "b": 5000, "c": 1, "e": 0}
    assert distinct_up_to(d.limit(0), ["a"], 3) == {"a": 0}


def test_no_expand_in_bounded_counts(spark, capsys):
    d = spark.range(100).select((F.col("id") % 3).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    profile.cardinality_counts(d).explain()
    encode.encode_recommend(d, ["a", "b"]).explain()
    assert "Expand" not in capsys.readouterr().out


# ---------------------------------------------------- moments and missing numbers


def test_moments_equal_pairwise_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5)) * [1, 10, 1e-3, 1, 1] + [0, 1e6, 5, 0, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 7.0
    x[::50, 4] = np.nan
    d = spark.createDataFrame([tuple(float(v) if i % 2 or not np.isnan(v) else None for i, v in enumerate(r)) for r in x], "a double, b double, c double, d double, e double").repartition(7)
    m = gram.moments(d, list("abcde"))
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert m.n[i, j] == both.sum()
            assert m.mean[i, j] == pytest.approx(x[both, i].mean())
            assert m.product[i, j] == pytest.approx(((x[both, i] - x[both, i].mean()) * (x[both, j] - x[both, j].mean())).sum(), rel=1e-6, abs=1e-6)
    r = {(c.col_a, c.col_b): c["corr"] for c in charts.correlation_matrix(d, list("abcde")).collect()}
    both = ~np.isnan(x[:, 0]) & ~np.isnan(x[:, 1])
    assert r["a", "b"] == pytest.approx(np.corrcoef(x[both, 0], x[both, 1])[0, 1]) and r["a", "e"] is None and r["e", "e"] == 1.0
    assert gram.moments(d.limit(0), ["a", "b"]).n.sum() == 0


def test_nan_is_left_out_everywhere(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (NAN, 8.0), (None, 1.0), (5.0, NAN)], "x double, y double")
    for method in ("builtin", "select"):
        r = profile.describe_numeric(d, ["x"], quantile_method=method).first()
        assert (r["count"], r["min"], r["max"], r.p50) == (4, 1.0, 5.0, 2.5)
    h = charts.histogram(d, "x", 4).collect()
    assert sum(r["count"] for r in h) == 4 and max(r.bin for r in h) == 3
    line = charts.ols_trend(d, "x", "y").first()
    assert (line.slope, line.intercept, line.n) == (2.0, 0.0, 3)
    st = transform.fit_pca(d, ["x", "y"], 2)
    assert st.params["mean"] == [2.0, 4.0] and not any(map(math.isnan, st.params["explained_variance_ratio"]))
    m = evaluate.metrics_regression(d.withColumnsRenamed({"x": "label", "y": "prediction"})).first()
    assert m.mae == pytest.approx(2.0) and not math.isnan(m.r2)
    assert profile.describe_numeric(spark.createDataFrame([(NAN,), (None,)], "x double"), ["x"]).first()["count"] == 0


def test_lambda_beyond_the_first_bracket(spark):
    rng = np.random.default_rng(5)
    # the seventh power of x is normal, so the best lambda is near seven
    x = np.abs(rng.normal(10, 1, 4000)) ** (1 / 7)
    d = spark.createDataFrame([(float(v), float(np.exp(v))) for v in x] + [(NAN, None)], "x double, z double").repartition(3)
    found = transform.fit_lambdas(d, ["x", "z"], "box-cox", {})

    def score(lam):
        y = (x ** lam - 1) / lam
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.log(x).sum()

    grid = np.linspace(found["x"] - 0.5, found["x"] + 0.5, 1001)
    assert found["x"] > 5.5 and abs(grid[np.argmax([score(v) for v in grid])] - found["x"]) <= 0.002
    yj = transform.fit_lambdas(d, ["x"], "yeo-johnson", {})["x"]
    assert yj > 5
    assert transform.fit_lambdas(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"], "box-cox", {}) == {"x": 1.0}


# -------------------------------------------------------------------- models


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, (600, 2))
    y = 100 + 30 * np.sin(2 * x[:, 0]) + 5 * x[:, 1] + rng.normal(0, 1, 600)
    return spark.createDataFrame([(int(i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k int, a double, b double, y double").repartition(4)


def r2(df):
    return evaluate.metrics_regression(df, "y", "prediction").first().r2


def test_svr_converges(curve, tmp_path):
    train, test = curve.where("k % 5 > 0"), curve.where("k % 5 = 0")
    m = KernelSVR("rbf", C_=10.0, epsilon=0.5).fit(train, ["a", "b"], "y")
    ridge = SparkModel("reg_ridge", {"alpha": 1.0}).fit(train, ["a", "b"], "y")
    assert r2(m.transform(test)) > max(0.9, r2(ridge.transform(test)))
    io.save_model(m, Pipeline(), f"file://{tmp_path}/svr")
    again, _ = io.load_model(f"file://{tmp_path}/svr")
    assert again.transform(test).select("k", "prediction").exceptAll(m.transform(test).select("k", "prediction")).isEmpty()


def test_svr_closed_case(spark):
    """Two points (-1, -1) and (1, 1): with room for errors of 0.2 the flattest line is 0.8 x."""
    d = spark.createDataFrame([(-1.0, -1.0), (1.0, 1.0)], "x double, y double")
    m = KernelSVR("linear", C_=1000.0, epsilon=0.2).fit(d, ["x"], "y")
    assert m.w[0] == pytest.approx(0.8, abs=5e-3) and m.b == pytest.approx(0.0, abs=5e-3)


@pytest.fixture(scope="module")
def three(spark):
    rng = random.Random(6)
    rows = [(i, c, rng.gauss(cx, 1.0), rng.gauss(cy, 1.0)) for i, (c, cx, cy) in enumerate([("a", 0, 0), ("b", 3, 0), ("c", 0, 3)] * 80)]
    return spark.createDataFrame(rows, "k int, cls string, x double, y double").repartition(4)


@pytest.mark.parametrize("kind,params", [("clf_svm", {}), ("clf_gbt", {"n_estimators": 5, "max_depth": 3})])
def test_probabilities_and_importances_above_two_classes(three, kind, params):
    m = SparkModel(kind, params).fit(three, ["x", "y"], "cls")
    rows = m.transform(three).collect()
    assert all(sum(r.probability) == pytest.approx(1) and r.confidence == max(r.probability) for r in rows)
    loss = -np.mean([math.log(r.probability[m.classes.index(r.cls)]) for r in rows])
    share = three.groupBy("cls").count().collect()
    assert loss < -np.mean([math.log(c["count"] / 240) for c in share]) * 0.8
    assert loss == pytest.approx(m.calibration["log_loss"], rel=1e-3)
    assert [r.Importance is not None and r.Importance > 0 for r in m.feature_importance(three.sparkSession).collect()] == [True, True]


def test_joint_calibration_is_no_worse_than_one_by_one(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 600)
    m = rng.normal(size=(600, 3))
    m[np.arange(600), y] += 1.5
    d = spark.createDataFrame([([float(v) for v in r], float(c)) for r, c in zip(m, y)], "margins array<double>, label double").repartition(3)
    fitted = fit_calibration(d, 3)
    p = np.array([r.p for r in d.select(probabilities(F.col("margins"), fitted).alias("p"), "label").collect()])
    labels = [int(r.label) for r in d.collect()]
    joint = -np.mean(np.log(p[np.arange(600), labels]))
    single = np.zeros((600, 3))
    mm = np.array([r.margins for r in d.collect()])
    for k in range(3):
        t, a, b = np.array(labels) == k, 1.0, 0.0
        for _ in range(200):  # a logistic curve for each class alone, shares brought to one
            q = 1 / (1 + np.exp(-(a * mm[:, k] + b)))
            a, b = a - 0.5 * ((q - t) * mm[:, k]).mean(), b - 0.5 * (q - t).mean()
        single[:, k] = 1 / (1 + np.exp(-(a * mm[:, k] + b)))
    single /= single.sum(axis=1, keepdims=True)
    assert joint == pytest.approx(fitted["log_loss"], rel=1e-4) and joint <= -np.mean(np.log(single[np.arange(600), labels])) + 1e-6


def test_kernel_svc_clusters_and_neighbours_are_saved(spark, three, tmp_path):
    svc = KernelSVC("poly", degree=2).fit(three, ["x", "y"], "cls")
    clusters = ClusterModel(k=3, restarts=2).fit(three, ["x", "y"])
    near = NeighborModel("clf_knn", {"n_neighbors": 3}).fit(three, ["x", "y"], "cls", "k")
    for name, m, cols, kw in (("svc", svc, ["k", "prediction", "confidence"], {}), ("km", clusters, ["k", "Cluster"], {}), ("knn", near, ["k", "prediction"], {"key": "k"})):
        io.save_model(m, Pipeline(), f"file://{tmp_path}/{name}")
        again, _ = io.load_model(f"file://{tmp_path}/{name}")
        a, b = ([tuple(r) for r in sorted(x.transform(three, **kw).select(cols).collect())] for x in (m, again))
        assert a == b
    assert all(sum(r.probability) == pytest.approx(1) for r in svc.transform(three).collect())


def test_minimise_finds_the_least_of_a_bent_valley():
    def f(v):
        x, y = v
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])
    best, value, _ = sums.minimise(f, np.array([-1.2, 1.0]), 500, 1e-16)
    assert best == pytest.approx([1, 1], abs=1e-3) and value < 1e-6


# ------------------------------------------------------- curves and scoring


def test_curves_of_every_class_equal_one_at_a_time(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        y = rng.choice("abc")
        p = [rng.randint(0, 10) + (4 if c == y else 0) for c in "abcd"]
        rows.append((y if i % 40 else None, [v / sum(p) for v in p]))
    d = spark.createDataFrame(rows, "y string, probability array<double>").repartition(4)
    classes = list("abcd")  # d has no rows: it has no curve
    roc, pr, auc = (f(d, "y", "probability", classes) for f in (evaluate.roc_curves, evaluate.pr_curves, evaluate.roc_aucs))
    key = lambda r: [(v is not None, v) for v in r]
    for i, c in enumerate("abc"):
        one = d.where("y is not null").withColumn("s", F.col("probability")[i])
        for many, single in ((roc, evaluate.roc_curve(one, "y", "s", c)), (pr, evaluate.pr_curve(one, "y", "s", c))):
            assert sorted((tuple(r)[1:] for r in many.where(F.col("class") == c).collect()), key=key) == sorted(map(tuple, single.collect()), key=key)
        assert auc.where(F.col("class") == c).first().auc == pytest.approx(evaluate.roc_auc(one, "y", "s", c).first().auc)
    assert {r["class"] for r in roc.select("class").distinct().collect()} == set("abc")


def test_confusion_matrix_of_actual_labels_only(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "a"), (None, "b")], "label string, prediction string")
    both, actual = evaluate.confusion_matrix(d).collect(), evaluate.confusion_matrix(d, labels="actual").collect()
    assert len(both) == 9 and sorted(map(tuple, actual)) == [("a", "a", 1), ("a", "b", 0), ("b", "a", 1), ("b", "b", 0)]


def test_scoring_refuses_what_validation_refuses(spark):
    train = spark.createDataFrame([(float(i), "p" if i % 2 else "q") for i in range(20)], "x double, y string")
    pipe = Pipeline().init_from_raw(train, target="y").set_features(["x"])
    nb = GaussianNB().fit(train, ["x"], "y")
    with pytest.raises(ValueError, match="numerical"):
        score_batch(pipe, nb, spark.createDataFrame([("abc",)], "x string"))
    with pytest.raises(ValueError, match="empty"):
        score_batch(pipe, nb, train.limit(0))
    out = score_batch(pipe, nb, train.withColumn("extra", F.lit(1)))
    assert out.columns == ["x", "y", "extra", "Predicted_y", "Confidence", "Accurate"] and out.count() == 20


def test_random_preset_is_a_raw_row(spark):
    d = spark.createDataFrame([(i, float(i), str(i)) for i in range(50)], "k int, x double, s string")
    stats = profile.raw_profile(d.drop("k"))
    drawn = {preset_rows(stats, spark, raw_df=d, key="k", seed=s).where("preset = 'random'").first()[1:] for s in range(5)}
    assert len(drawn) > 1 and all(str(int(x)) == s for x, s in drawn)
