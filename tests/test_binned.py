"""Tree ensembles grown from counts: the same as Spark's from the rows where nothing is random."""
import random

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabforge.models import binned, spark_ml
from tabforge.models.spark_ml import SparkModel
from tabforge.plans import catalog_models
from tabforge.plans.catalog import QUERIES
from tabforge.plans.pipeline import Pipeline
from tabforge.sources import io


def _three_classes(spark, n=700):
    rng = random.Random(3)
    at = {"a": (0, 0), "b": (2, 0), "c": (0, 2)}
    rows = [(i, c, rng.gauss(at[c][0], 1.0), float(round(rng.gauss(at[c][1], 1.0) * 3)), 5.0) for i, c in enumerate(rng.choices("abc", k=n))]
    return spark.createDataFrame(rows, "id int, y string, p double, q double, same double").repartition(3)


def _trees(model):
    return [t.toDebugString.split("\n", 1)[1:] for t in model.trees]


def _both(monkeypatch, rows, features, kind, params):
    """Grown from counts, and by Spark from the rows."""
    monkeypatch.setattr(spark_ml, "FOREST_ROWS", 0)
    counted = SparkModel(kind, params).fit(rows, features, "y")
    monkeypatch.setattr(SparkModel, "_cells", lambda *_: None)
    return counted, SparkModel(kind, params).fit(rows, features, "y")


def _same(a, b, rows):
    x = a.transform(rows).select("id", "prediction", "probability")
    y = b.transform(rows).select("id", F.col("prediction").alias("p"), F.col("probability").alias("q"))
    return x.join(y, "id").where("prediction = p and aggregate(zip_with(probability, q, (u, v) -> abs(u - v)), 0D, (s, v) -> s + v) < 1e-9").count()


def test_one_tree_from_counts_is_that_of_the_rows(spark):
    rows = _three_classes(spark).withColumn("label", F.when(F.col("y") == "a", 0.0).when(F.col("y") == "b", 1.0).otherwise(2.0))
    names = ["p", "same", "q"]
    est = C.RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=1, bootstrap=False, maxDepth=5, minInstancesPerNode=3)
    plain = est.fit(rows.select(array_to_vector(F.array(*names)).alias("v"), "label"))
    m = binned.fit_forest(binned.cells_of(rows, names, "label", 3, 700), est)
    assert _trees(m) == _trees(plain) and len(_trees(m)[0][0]) > 500
    assert np.allclose(m.featureImportances.toArray(), plain.featureImportances.toArray())
    points = rows.select(array_to_vector(F.array(*names)).alias("v"))
    assert [m.transform(points).select("rawPrediction", "prediction").collect()] == [plain.transform(points).select("rawPrediction", "prediction").collect()]


def test_forest_of_many_rows_is_grown_from_counts(spark, monkeypatch, tmp_path):
    rows = _three_classes(spark)
    seen = []
    keep = binned.count_cells
    monkeypatch.setattr(binned, "count_cells", lambda *a: seen.append(1) or keep(*a))
    m, plain = _both(monkeypatch, rows, ["p", "q"], "clf_random_forest", {"n_estimators": 30, "max_depth": 6})
    assert seen == [1] and m.model.getNumTrees == 30 and not m.more
    assert len({str(t) for t in _trees(m.model)}) == 30  # each from cells weighed anew
    right = [x.transform(rows).where("y = prediction").count() for x in (m, plain)]
    assert abs(right[0] - right[1]) < 25
    sizes = [np.mean([t.numNodes for t in x.model.trees]) for x in (m, plain)]
    assert 0.85 < sizes[0] / sizes[1] < 1.15
    assert {r.param: r.value for r in m.param_table(spark).collect()}["numTrees"] == "30"
    assert abs(sum(r.Importance for r in m.feature_importance(spark).collect()) - 1) < 1e-9
    io.save_model(m, Pipeline(), str(tmp_path / "m"))
    assert _same(m, io.load_model(str(tmp_path / "m"))[0], rows) == 700


def test_cells_hold_every_row_and_wide_features_have_quantile_cuts(spark, monkeypatch):
    rows = _three_classes(spark).withColumn("label", F.when(F.col("y") == "a", 0.0).otherwise(1.0))
    for limit in (binned.VALUES, 40):  # the second: p by quantiles
        monkeypatch.setattr(binned, "VALUES", limit)
        cells = binned.cells_of(rows, ["p", "q"], "label", 2, 700)
        bins, by_class = cells.arrays()
        assert by_class.sum() == 700 and by_class[:, 0].sum() == rows.where("label = 0").count()
        share = np.bincount(bins[0], by_class.sum(axis=1)) / 700
        assert len(share) in (31, 32) and share.max() < 0.06
        found = binned.bins_of(rows.select(F.col("id"), F.col("label"), F.col("p"), F.col("q"), array_to_vector(F.array("p", "q")).alias("v")), "v", cells.cuts)
        want = {(r.p, r.q): int(np.searchsorted(cells.cuts[0], r.p) * (len(cells.cuts[1]) + 1) + np.searchsorted(cells.cuts[1], r.q)) for r in found.collect()}
        assert all(want[(r.p, r.q)] == r["__bins"] for r in found.collect())
        inside = binned.bins_of(cells.grid().withColumnRenamed("__bins", "number"), "__features", cells.cuts)
        assert inside.where("number <> __bins").isEmpty()


def test_values_on_a_cut_are_below_it(spark):
    cuts = [np.array([-1.5, 0.0, 2.0]), np.array([]), np.array([0.1])]
    xs = [-2.0, -1.5, -1.4, -0.0, 0.0, 5e-324, 2.0, 2.1]
    rows = spark.createDataFrame([(x, 7.0, y) for x in xs for y in (0.1, 0.2)], "a double, b double, c double")
    got = binned.bins_of(rows.select("a", "c", array_to_vector(F.array("a", "b", "c")).alias("v")), "v", cuts).collect()
    assert all(r["__bins"] == np.searchsorted(cuts[0], r.a) * 2 + (r.c > 0.1) for r in got)


def test_predictions_by_bins_are_those_of_the_model(spark, monkeypatch):
    rows = _three_classes(spark)
    monkeypatch.setattr(spark_ml, "FOREST_ROWS", 0)
    monkeypatch.setattr(spark_ml, "ROWS_PER_ANSWER", 0)
    for kind, params in [("clf_random_forest", {"n_estimators": 5, "max_depth": 4}), ("clf_gbt", {"n_estimators": 5, "max_depth": 3})]:
        m = SparkModel(kind, params).fit(rows, ["p", "q"], "y")
        assert m.answers
        more = rows.unionByName(rows.limit(50).withColumns({"p": F.col("p") * 100, "id": F.col("id") + 1000}))
        by_bins = m.transform(more).localCheckpoint()
        for limit in (0, spark_ml.BROADCAST_ANSWERS):
            monkeypatch.setattr(spark_ml, "BROADCAST_ANSWERS", limit)
            assert m.transform(more).exceptAll(by_bins).isEmpty()
        with pytest.raises(Exception, match="null"):
            m.transform(rows.withColumn("q", F.when(F.col("id") > 5, F.col("q")))).select("prediction").collect()
        m.answers = None
        assert m.transform(more).exceptAll(by_bins).isEmpty() and by_bins.count() == 750


def test_missing_values_are_refused_as_before(spark, monkeypatch):
    rows = _three_classes(spark)
    monkeypatch.setattr(spark_ml, "FOREST_ROWS", 0)
    for bad in (F.lit(None), F.lit(float("nan"))):
        with pytest.raises(Exception, match="null|NaN"):
            SparkModel("clf_random_forest", {"n_estimators": 3, "max_depth": 3}).fit(rows.withColumn("q", F.when(F.col("id") == 5, bad).otherwise(F.col("q"))), ["p", "q"], "y")


def test_more_cells_than_the_limit_go_by_rows(spark, monkeypatch):
    rows = _three_classes(spark)
    monkeypatch.setattr(spark_ml, "FOREST_ROWS", 0)
    monkeypatch.setattr(binned, "CELLS", 10)
    m = SparkModel("clf_random_forest", {"n_estimators": 3, "max_depth": 3}).fit(rows, ["p", "q"], "y")
    assert m.answers is None and m.transform(rows).where("y = prediction").count() > 400


def test_boosted_trees_from_counts_are_those_of_the_rows(spark, monkeypatch):
    rows = _three_classes(spark)
    for part in (rows, rows.where("y <> 'c'")):
        with monkeypatch.context() as own:
            m, plain = _both(own, part, ["p", "same", "q"], "clf_gbt", {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3})
        assert _same(m, plain, part) == part.count()
        assert (m.calibration is None) == (part is not rows)
        if m.calibration:
            assert np.allclose(m.calibration["slope"], plain.calibration["slope"], rtol=1e-6)


def test_boosted_query_has_the_trees_of_the_reference(spark, monkeypatch):
    asked = {}

    class Seen(Exception):
        pass

    def fit(self, *_):
        asked.update(self.params)
        raise Seen

    monkeypatch.setattr(SparkModel, "fit", fit)
    monkeypatch.setattr(catalog_models, "_clf_data", lambda *_: (None, None))
    with pytest.raises(Seen):
        QUERIES["clf_gbt"](spark, "")
    assert asked["n_estimators"] == 100


def test_importances_of_a_large_table_come_from_counts(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 40).cast("double").alias("l_quantity"), (F.col("id") * 7 % 1009).cast("double").alias("l_extendedprice"),
                                    (F.col("id") % 3).cast("double").alias("l_discount"), F.lit(0.0).alias("l_tax"), F.when(F.col("id") % 40 > 20, "A").otherwise("R").alias("l_returnflag"))
    monkeypatch.setattr(spark_ml, "FOREST_ROWS", 0)
    monkeypatch.setattr(catalog_models, "_clf_data", lambda *_: (rows, None))
    fitted = []
    keep = spark_ml.fit_forest
    monkeypatch.setattr(spark_ml, "fit_forest", lambda *a: fitted.append(keep(*a)) or fitted[-1])
    found = {r.Feature: r.Importance for r in QUERIES["feature_importance"](spark, "").collect()}
    assert fitted[0].getNumTrees == 100 and max(t.depth for t in fitted[0].trees) <= 12
    assert sum(found.values()) == pytest.approx(1, abs=1e-5) and found["l_quantity"] > 0.6 and found["l_tax"] == 0
