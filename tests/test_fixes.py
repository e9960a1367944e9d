"""Replay, report and mode on cases with nulls, predicted-only classes and wide integers."""
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from tabforge.functions.order_stats import order_statistics
from tabforge.models.naive_bayes import GaussianNB
from tabforge.models.spark_ml import SparkModel
from tabforge.operators import charts, evaluate, impute, outliers
from tabforge.operators.sample import split_random, split_stratified
from tabforge.operators.scale import fit_scaler
from tabforge.plans.pipeline import Pipeline, score_batch
from tabforge.sources import io


def test_fallback_fills_raw_values_before_scaling(spark):
    train = spark.createDataFrame([(float(i), "a") for i in range(100, 200)], "x double, y string")
    p = Pipeline().init_from_raw(train, "y")
    p.append(fit_scaler(train, ["x"], "standard"))
    p.set_features(["x"])
    got = p.transform(spark.createDataFrame([(None, "a")], "x double, y string")).collect()[0].x
    assert abs(got) < 0.05  # the median of the raw values, scaled


def test_scoring_without_a_feature_raises(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    p = Pipeline().init_from_raw(train, "y").set_features(["x"])
    with pytest.raises(ValueError, match="x"):
        score_batch(p, None, train.select("y"))


def test_report_lists_predicted_only_classes(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "label string, prediction string")
    rows = {r.row: r for r in evaluate.classification_report(d).collect()}
    assert rows["c"].support == 0 and rows["c"].precision == 0.0 and "macro avg" in rows


def test_fits_skip_nan_on_both_quantile_paths(spark):
    nan = float("nan")
    d = spark.createDataFrame([(nan,), (1.0,), (2.0,), (3.0,), (100.0,)], "x double")
    for method in ("builtin", "select"):
        assert outliers.iqr_bounds(d, ["x"], quantile_method=method)["x"] == (-36.5, 65.5)
    assert fit_scaler(d, ["x"], "standard").params["center"]["x"] == 26.5
    assert "x" in outliers.zscore_bounds(d, ["x"])
    assert outliers.outlier_count(d, {"x": (0.0, 50.0)}).collect()[0].n_out == 1


def test_box_stats_with_a_null_group(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", 7.0), ("b", None)], "g string, v double")
    got = [sorted((str(r.g), r.q1, r.median, r.q3) for r in charts.box_stats(d, "v", "g", quantile_method=m).collect())
           for m in ("auto", "select")]
    assert got[0] == got[1] == [("None", 5.0, 5.0, 5.0), ("a", 1.5, 2.0, 2.5), ("b", 7.0, 7.0, 7.0)]


def test_order_statistics_fetch_a_bounded_number(spark):
    d = spark.createDataFrame([(i % 7, float(i * i % 1009)) for i in range(2000)], "g int, v double")
    want = {(g,): sorted(float(i * i % 1009) for i in range(2000) if i % 7 == g) for g in range(7)}
    got = order_statistics(d, ["g"], {g: [10, 200] for g in want}, buckets=16, collect_limit=20)
    assert got == {(g, k): v[k] for g, v in want.items() for k in (10, 200)}


def test_stratified_split_with_a_null_class(spark):
    d = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(90)], "k int, y string")
    got = {r.y: r.n for r in split_stratified(d, "k", "y", 0.2).where("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {None: 6, "a": 6, "b": 6}


def test_random_split_is_exact_with_repeated_keys(spark):
    d = spark.createDataFrame([(i % 5, i) for i in range(100)], "k int, v int")
    assert split_random(d, "k", 0.5).where("split = 'test'").count() == 50


def test_naive_bayes_saved_with_its_pipeline(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (8.0, "b"), (9.0, "b")], "x double, y string")
    p = Pipeline().init_from_raw(train, "y").set_features(["x"])
    nb = GaussianNB().fit(train, ["x"], "y")
    io.save_model(nb, p, str(tmp_path / "m"))
    model, pipe = io.load_model(str(tmp_path / "m"))
    assert model.state() == nb.state()
    assert [tuple(r) for r in score_batch(pipe, model, train, keep_raw=True).select("x", "Predicted_y").collect()] == [
        (1.0, "a"), (2.0, "a"), (8.0, "b"), (9.0, "b")]


def test_row_ids_count_through_the_partitions(spark):
    d = io.with_row_id(spark.range(0, 1000, 1, 7).where("id % 3 > 0"))
    assert [r._row_id for r in d.orderBy("id").collect()] == list(range(d.count()))


def test_clamped_tree_depth_is_reported(spark):
    d = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    rows = {r.param: r.value for r in SparkModel("clf_decision_tree", {"max_depth": 50}).fit(d, ["x"], "y").param_table(spark).collect()}
    assert rows["maxDepth"] == "30" and rows["warning.1"] == "max_depth 50 clamped to 30"


def test_mode_of_wide_integers(spark):
    big = 2 ** 53
    d = spark.createDataFrame([(big,)] * 2 + [(big + 1,)] * 3, "x long")
    assert impute.column_modes(d, ["x"])["x"] == big + 1


@pytest.mark.parametrize("name, table", [("scatter_points", "part"), ("scatter_3d_points", "embeddings")])
def test_scatter_points_returns_every_row(spark, name, table):
    sf = "/root/testdata/sf0.01"
    assert E.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
