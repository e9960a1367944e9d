"""What changes with the size of a table: limits set low give the same rows as the plain way."""
import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from tabforge.models import kernel_svm, spark_ml
from tabforge.models.spark_ml import SparkModel
from tabforge.operators import charts, iforest, neighbors, sample
from tabforge.plans import inputs
from tabforge.plans.pipeline import Pipeline
from tabforge.sources import io


def _two_classes(spark, n=400):
    rows = spark.range(n).select("id", (F.col("id") % 20).cast("double").alias("a"), ((F.col("id") * 7) % 11).cast("double").alias("b"))
    return rows.withColumn("y", F.when(F.col("a") + F.col("b") / 20 > 9.6, "hi").otherwise("lo")).withColumn("t", 3 * F.col("a") + F.col("b"))


def test_forest_of_a_large_table_is_fitted_in_parts(spark, monkeypatch, tmp_path):
    rows = _two_classes(spark)
    monkeypatch.setattr(spark_ml, "TREE_BYTES", 4 * 400 * 4)
    m = SparkModel("clf_random_forest", {"n_estimators": 10, "max_depth": 5}).fit(rows, ["a", "b"], "y")
    parts = [m.model, *m.more]
    assert len(parts) == 3 and sum(p.getNumTrees for p in parts) == 10
    got = m.transform(rows).select("id", "y", "prediction", "probability", "confidence", "prediction_index")
    assert got.where("y = prediction").count() >= 390
    assert got.where("abs(aggregate(probability, 0D, (x, v) -> x + v) - 1) > 1e-9 or confidence < 0.5").count() == 0
    imp = {r.Feature: r.Importance for r in m.feature_importance(spark).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["a"] > imp["b"]
    assert {r.param: r.value for r in m.param_table(spark).collect()}["numTrees"] == "10"
    io.save_model(m, Pipeline(), str(tmp_path / "m"))
    again, _ = io.load_model(str(tmp_path / "m"))
    assert len(again.more) == 2
    assert again.transform(rows).select(*got.columns).exceptAll(got).isEmpty()
    r = SparkModel("reg_random_forest", {"n_estimators": 10, "max_depth": 5}).fit(rows, ["a", "b"], "t")
    assert len(r.more) == 2
    assert r.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("t")))).first()[0] < 6


def test_votes_of_parts_are_those_of_their_trees(spark, monkeypatch):
    rows = _two_classes(spark)
    monkeypatch.setattr(spark_ml, "TREE_BYTES", 4 * 400 * 4)
    m = SparkModel("clf_random_forest", {"n_estimators": 8, "max_depth": 2}).fit(rows, ["a", "b"], "y")
    at = rows.where("id % 37 = 0").orderBy("id")
    votes = []
    for r in at.collect():
        from pyspark.ml.linalg import Vectors
        votes.append(sum(p.predictRaw(Vectors.dense(r.a, r.b)).toArray() for p in [m.model, *m.more]))
    got = [r.probability for r in m.transform(at).orderBy("id").collect()]
    assert np.allclose(got, np.array(votes) / 8)


def test_kernel_classifier_of_a_large_table(spark, monkeypatch):
    rows = _two_classes(spark).withColumn("y", F.when(F.col("b") > 9, "top").otherwise(F.col("y"))).withColumns({"a": F.col("a") / 20, "b": F.col("b") / 11})
    plain = kernel_svm.KernelSVC(kernel="rbf", n_components=20, max_iter=20).fit(rows, ["a", "b"], "y").transform(rows)
    seen = []
    monkeypatch.setattr(kernel_svm, "written", lambda df, name: seen.append(name) or df)
    monkeypatch.setattr(kernel_svm, "TABLE_BYTES", 0)
    large = kernel_svm.KernelSVC(kernel="rbf", n_components=20, max_iter=20).fit(rows, ["a", "b"], "y").transform(rows)
    assert seen == ["margins"]
    same = plain.select("id", F.col("prediction").alias("p")).join(large, "id").where("p = prediction").count()
    assert same >= 396


def test_linear_classifier_of_a_large_table(spark, monkeypatch):
    rows = _two_classes(spark)
    plain = SparkModel("clf_svm", {"max_iter": 20}).fit(rows, ["a", "b"], "y").transform(rows)
    monkeypatch.setattr(spark_ml, "TABLE_BYTES", 0)
    large = SparkModel("clf_svm", {"max_iter": 20}).fit(rows, ["a", "b"], "y").transform(rows)
    assert plain.select("id", F.col("prediction").alias("p")).join(large, "id").where("p = prediction").count() == 400


def test_restarts_side_by_side_keep_the_lowest_cost(spark):
    from pyspark.ml.clustering import KMeans
    rows = spark.range(60).select("id", (F.col("id") % 6 * 10 + F.rand(1)).alias("x"), (F.col("id") % 3 * 5 + F.rand(2)).alias("y"))
    rows.cache()
    m = spark_ml.fit_kmeans(rows, ["x", "y"], k=4, restarts=6)
    data = spark_ml._assemble(rows, ["x", "y"])
    costs = [KMeans(featuresCol="__features", k=4, seed=s, maxIter=300, tol=1e-6).fit(data).summary.trainingCost for s in range(42, 48)]
    assert abs(m.summary.trainingCost - min(costs)) < 1e-9


def test_large_derived_table_is_written_and_not_held(spark, monkeypatch):
    rows = spark.range(20).withColumn("k", F.col("id") % 3)
    monkeypatch.setattr(inputs, "KEPT_BYTES", 0)
    out = inputs.kept(rows)
    assert out.storageLevel == StorageLevel.NONE and out.inputFiles()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))


def test_first_rows_by_hash_digits(spark, monkeypatch):
    rows = spark.createDataFrame([(i // 2, f"v{i}") for i in range(600)] + [(None, "x")], "k int, v string")
    for limit in (200_000, 2):  # the second needs narrower buckets
        monkeypatch.setattr(sample, "COLLECT_LIMIT", limit)
        got = sample.select_first_k(rows, ["k"], 101)
        assert got.columns == ["k", "v", "__sel"]
        order = F.concat(sample.seeded_hash(["k"], 42), F.lpad(F.hex(F.xxhash64("k", "v")), 16, "0"))
        want = sorted(r.h for r in rows.select(order.alias("h")).collect())[:101]
        assert sorted(r.h for r in got.where("__sel").select(order.alias("h")).collect()) == want


def test_box_stats_do_not_bring_a_large_group_together(spark, monkeypatch):
    rows = spark.createDataFrame([("a", float(i % 50)) for i in range(300)] + [("b", float(i)) for i in range(9)] + [(None, 1.0), (None, 5.0), ("b", None)],
                                 "g string, v double")
    want = sorted(map(str, charts.box_stats(rows, "v", "g").collect()))
    monkeypatch.setattr(charts, "LARGE_GROUP", 5)
    large = charts.box_stats(rows, "v", "g")
    assert sorted(map(str, large.collect())) == want
    monkeypatch.setattr(charts, "LARGE_GROUP", 0)
    plan = charts.box_stats(rows, "v", "g")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert charts.box_outliers(rows, "v", large, "g").isEmpty()


def test_forest_scores_are_made_once_for_the_cut(spark, monkeypatch):
    rows = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("x"), F.rand(3).alias("y"))
    made = []
    keep = iforest.written
    monkeypatch.setattr(iforest, "written", lambda df, name: made.append(name) or keep(df, name))
    model = iforest.fit_isolation_forest(rows, ["x", "y"], ["id"], n_trees=5, max_samples=32)
    assert made == ["forest-scores"]
    scores = sorted(r.anomaly_score for r in iforest.score_isolation_forest(rows, model).collect())
    assert abs(model["cut"] - np.quantile(scores, 0.95)) < 1e-9


def test_rough_distances_lose_no_neighbour(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 8)), 1e6 + rng.normal(size=(60, 8)) * 1e-3, np.repeat(rng.normal(size=(3, 8)), 5, axis=0)])
    q = x[::4]
    near, room = neighbors.rough_distances(q, x)
    exact = neighbors.squared_distances(q, x)
    assert (np.abs(near - exact) <= room[:, None]).all()
    i, j = np.nonzero(exact >= 0)
    assert (neighbors.pair_distances(q, x, i, j).reshape(exact.shape) == exact).all()
    huge, none = neighbors.rough_distances(q * 1e160, x)
    assert (none == 0).all() and huge.shape == exact.shape
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, " + ", ".join(f"c{d} double" for d in range(8)))
    got = neighbors.nearest_squared(points.where("id % 4 = 0"), points, [f"c{d}" for d in range(8)], 4, "id", "id", leaf_rows=20)
    for r in got.collect():
        d = exact[r.id // 4]
        want = sorted(range(len(x)), key=lambda n: (d[n], n))[:4]
        assert [f.id for f in r.found] == want and [f.d2 for f in r.found] == [d[n] for n in want]


def test_order_statistics_by_columns_are_those_of_the_long_form(spark):
    from tabforge.functions.order_stats import long_form, order_statistics, quantiles
    rows = spark.createDataFrame([(float(i * i % 997), i % 40, None if i % 3 else float(-i)) for i in range(2000)] + [(float("nan"), None, 1e300)],
                                 "a double, b int, c double")
    cols, want = ["a", "b", "c"], {(0,): [0, 500, 1999], (1,): [7, 1000], (2,): [0, 333, 667]}
    long = long_form(rows, cols)
    plain = order_statistics(long, ["__c"], want, buckets=16, collect_limit=20)
    assert order_statistics(long, ["__c"], want, buckets=16, collect_limit=20, columns=(rows, cols)) == plain
    assert quantiles(rows, cols, [0.1, 0.5], method="select") == quantiles(rows, cols, [0.1, 0.5], method="builtin")


def test_kernel_classes_side_by_side_reach_the_objective_of_one_by_one(spark, monkeypatch, tmp_path):
    rows = _two_classes(spark).withColumn("y", F.when(F.col("b") > 9, "top").otherwise(F.col("y"))).withColumns({"a": F.col("a") / 20, "b": F.col("b") / 11})
    data = rows.select("a", "b", "y").collect()

    def objectives(m, part):
        w, b, scale = kernel_svm.random_features(2, m.gamma, m.D, m.seed)
        z = scale * np.cos(np.array([[r.a, r.b] for r in part]) @ w.T + b)
        models = m.model.models if len(m.classes) > 2 else [m.model]
        for c, one in zip(m.classes if len(models) > 1 else m.classes[1:], models):
            t, v = np.where(np.array([r.y for r in part]) == c, 1, -1), one.coefficients.toArray()
            yield np.maximum(0, 1 - t * (z @ v + one.intercept)).mean() + (v @ v) / (2 * len(part))

    for part, few in ((rows, data), (rows.where("y <> 'top'"), [r for r in data if r.y != "top"])):
        monkeypatch.setattr(kernel_svm, "STEP_BYTES", 1 << 30)
        plain = kernel_svm.KernelSVC(kernel="rbf", n_components=20, max_iter=30).fit(part, ["a", "b"], "y")
        monkeypatch.setattr(kernel_svm, "STEP_BYTES", 0)
        m = kernel_svm.KernelSVC(kernel="rbf", n_components=20, max_iter=30).fit(part, ["a", "b"], "y")
        assert plain._margins is None and m._margins is not None
        for ours, theirs in zip(objectives(m, few), objectives(plain, few)):
            assert ours <= theirs * 1.02 + 1e-3
        got = m.transform(part).select("id", "prediction", "prediction_index", F.round(F.element_at("probability", 1), 9).alias("p"))
        assert got.join(plain.transform(part).select("id", F.col("prediction").alias("q")), "id").where("prediction = q").count() >= 0.97 * len(few)
        io.save_model(m, Pipeline(), str(tmp_path / f"m{len(few)}"))
        again, _ = io.load_model(str(tmp_path / f"m{len(few)}"))
        assert again.transform(part).select("id", "prediction", "prediction_index", F.round(F.element_at("probability", 1), 9).alias("p")).exceptAll(got).isEmpty()
    with pytest.raises(Exception, match="null"):
        m.transform(rows.withColumn("b", F.when(F.col("id") > 3, F.col("b")))).select("prediction").collect()
    with pytest.raises(Exception, match="null"):
        kernel_svm.KernelSVC(kernel="rbf", n_components=20, max_iter=30).fit(rows.withColumn("b", F.when(F.col("id") > 3, F.col("b"))), ["a", "b"], "y")
