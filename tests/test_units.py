"""Unit checks on tiny tables: NULL/NaN, empty, constant, ties, unseen categories, closed forms."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabforge.functions import dictionary
from tabforge.functions.order_stats import order_statistics, quantiles, running_totals
from tabforge.models.naive_bayes import GaussianNB
from tabforge.models.spark_ml import SparkModel
from tabforge.operators import clean, encode, evaluate, impute, outliers, profile, sample, scale, transform
from tabforge.plans.pipeline import Pipeline, align_features, score_batch
from tabforge.plans.stage import Stage


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    p = profile.profile_table(df).collect()[0]
    assert p["missing_count"] == 3 and p["rows"] == 3


def test_profile_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    p = profile.profile_table(df).collect()[0]
    assert p["rows"] == 0 and p["health_score"] == 0


def test_health_score_single_column_penalty(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert profile.profile_table(df).collect()[0]["health_score"] == 80


def test_constant_columns_null_rules(spark):
    df = spark.createDataFrame([(1, None, 5, None), (1, None, 6, 2)], "a int, b string, c int, d int")
    assert profile.constant_columns(df) == ["a", "b"]  # d holds a value and a NULL: two distinct


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), ("a",), (None,)], "s string")
    assert impute.column_modes(df, ["s"]) == {"s": "a"}
    num = spark.createDataFrame([(10.0,), (9.0,), (10.0,), (9.0,)], "x double")
    assert impute.column_modes(num, ["x"]) == {"x": 9.0}  # numeric order, not text order


def test_constant_fill_is_type_checked(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(ValueError):
        impute.fit_impute(df, ["x"], "constant")


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(0.0,), (None,), (10.0,), (3.0,)], "x double")
    st = Stage("clip", {"bounds": {"x": [1.0, 5.0]}})
    assert [r[0] for r in st.apply(df).collect()] == [1.0, None, 5.0, 3.0]


def test_winsorize_matches_rank_rule(spark):
    vals = list(range(100))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    b = outliers.winsor_bounds(df, ["x"], 0.05, 0.05)
    assert b["x"] == (5.0, 94.0)


def test_dedup_keep_none_and_first(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4), (5, None, 5)], "id int, k string, v int")
    assert sorted(r.id for r in clean.dedup(df, ["k"], False).collect()) == [3]
    assert sorted(r.id for r in clean.dedup(df, ["k"], "first", "id").collect()) == [1, 3, 4]
    assert sorted(r.id for r in clean.dedup(df, ["k"], "last", "id").collect()) == [2, 3, 5]


def test_one_hot_null_dummy_and_unseen(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    st = encode.fit_one_hot(df, ["c"])
    assert st.apply(df).columns == ["c_nan", "c_x", "c_y"]
    new = spark.createDataFrame([("z",)], "c string")
    assert list(st.apply(new).collect()[0]) == [0, 0, 0]  # unseen: all zero when not capped


def test_one_hot_capped_sends_unseen_to_other(spark):
    rows = [(f"v{i:02d}",) for i in range(40) for _ in range(40 - i)]
    df = spark.createDataFrame(rows, "c string")
    st = encode.fit_one_hot(df, ["c"], cap=30, keep=29)
    out = st.apply(spark.createDataFrame([("never",), (None,)], "c string"))
    assert all(r["c_Other"] == 1 for r in out.collect())
    assert len(out.columns) == 30


def test_one_hot_rows_sum_to_one(spark):
    df = spark.createDataFrame([(s,) for s in "abcabcaab"], "c string")
    out = encode.fit_one_hot(df, ["c"]).apply(df)
    assert {sum(r) for r in out.collect()} == {1}


def test_label_unseen_is_minus_one(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    st = encode.fit_index(df, ["c"], "label")
    assert {r.value: r.code for r in dictionary.load(spark, st.params).collect()} == {"Missing": 0, "a": 1, "b": 2}
    assert st.apply(spark.createDataFrame([("zz",)], "c string")).collect()[0][0] == -1


def test_scale_inverse_is_identity(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "a double, b double")
    for kind in ["standard", "minmax", "robust", "maxabs"]:
        st = scale.fit_scaler(df, ["a", "b"], kind)
        back = scale.inverse_scale(st.apply(df), st)
        for r0, r1 in zip(df.orderBy("a").collect(), back.orderBy("a").collect()):
            assert r0[0] == pytest.approx(r1[0]) and r0[1] == pytest.approx(r1[1])


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    for kind in ["standard", "minmax", "robust", "maxabs"]:
        vals = [r[0] for r in scale.fit_scaler(df, ["x"], kind).apply(df).collect()]
        assert vals == [0.0, 0.0] or kind == "maxabs"


def test_adjusted_skew_kurt_match_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.exponential(size=500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    d = profile.describe_numeric(df, ["x"], places=12).collect()[0]
    s = pd.Series(x)
    assert d["skewness"] == pytest.approx(s.skew(), rel=1e-9)
    assert d["kurtosis"] == pytest.approx(s.kurt(), rel=1e-9)
    assert d["p25"] == pytest.approx(s.quantile(0.25), rel=1e-12)


def test_poly_term_names():
    names = [n for n, _ in transform.poly_terms(["a", "b"], 2)]
    assert names == ["a", "b", "a^2", "a b", "b^2"]
    names = [n for n, _ in transform.poly_terms(["a", "b", "c"], 3, interaction_only=True, include_bias=True)]
    assert names == ["1", "a", "b", "c", "a b", "a c", "b c", "a b c"]


def test_pca_is_centred_and_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) @ np.array([[2.0, 0.5, 0.0], [0.0, 1.0, 0.3], [0.0, 0.0, 0.2]]) + 10
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    st = transform.fit_pca(df, ["a", "b", "c"], 2, standardize=False)
    out = np.array([[r["PC_1"], r["PC_2"]] for r in st.apply(df).collect()])
    assert abs(out.mean(axis=0)).max() < 1e-9
    xc = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    ref = xc @ vt[:2].T
    for k in range(2):
        assert abs(abs(np.corrcoef(out[:, k], ref[:, k])[0, 1]) - 1) < 1e-9


def test_gaussian_nb_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(scale=0.5, size=200) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    nb = GaussianNB().fit(df, ["a", "b"], "y")
    eps = 1e-9 * x.var(axis=0).max()
    for k, cls in enumerate([0, 1]):
        xs = x[y == cls]
        assert nb.theta[k] == pytest.approx(list(xs.mean(axis=0)))
        assert nb.var[k] == pytest.approx(list(xs.var(axis=0) + eps))
    pred = nb.transform(df).select("prediction", "probability").collect()
    jll = np.stack([np.log(nb.prior[k]) - 0.5 * np.sum(np.log(2 * np.pi * np.array(nb.var[k])))
                    - 0.5 * np.sum((x - np.array(nb.theta[k])) ** 2 / np.array(nb.var[k]), axis=1) for k in range(2)], 1)
    assert [r[0] for r in pred] == list(jll.argmax(axis=1))
    p = np.exp(jll - jll.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(np.array([r[1] for r in pred]), p)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = x @ np.array([3.0, -2.0]) + 1.0 + rng.normal(scale=0.1, size=400)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    m = SparkModel("reg_ridge", {"alpha": 10.0}).fit(df, ["a", "b"], "y")
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(2), xc.T @ yc)
    assert np.allclose(m.model.coefficients.toArray(), w, atol=1e-4)


def test_classification_metrics_weighted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    r = evaluate.metrics_classification(df, "y", "p").collect()[0]
    # sklearn: accuracy .5, precision_weighted = (2*1 + 1*(1/3) + 1*0)/4, recall = (2*.5 + 1 + 0)/4
    assert r["accuracy"] == pytest.approx(0.5)
    assert r["precision"] == pytest.approx((2 * 1 + 1 / 3) / 4)
    assert r["recall"] == pytest.approx(0.5)


def test_roc_auc_matches_rank_formula(spark):
    rng = np.random.default_rng(4)
    s = rng.random(300).round(2)
    y = (rng.random(300) < s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = evaluate.roc_auc(df, "y", "s", 1).collect()[0][0]
    pos, neg = s[y == 1], s[y == 0]
    ref = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(ref)


def test_pipeline_replay_equals_fit_output(spark):
    rows = [(float(i % 7) if i % 5 else None, float(i), "x" if i % 3 else "y") for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    pipe = Pipeline().init_from_raw(df, target=None)
    d = pipe.fit_step(df, impute.fit_impute(df, ["a"], "median"))
    d = pipe.fit_step(d, outliers.fit_outliers(d, ["a", "b"], "iqr"))
    d = pipe.fit_step(d, encode.fit_one_hot(d, ["c"]))
    d = pipe.fit_step(d, scale.fit_scaler(d, ["a", "b"], "standard"))
    pipe.set_features(["a", "b", "c_x", "c_y"])
    replay = pipe.transform(df)
    fitted = align_features(d, ["a", "b", "c_x", "c_y"])
    assert sorted(map(tuple, replay.collect())) == sorted(map(tuple, fitted.collect()))
    again = Pipeline.from_json(pipe.to_json()).transform(df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fitted.collect()))


def test_validate_raw_input_reports(spark):
    df = spark.createDataFrame([(1.0, "a", 1)], "x double, s string, y int")
    pipe = Pipeline().init_from_raw(df, target="y")
    bad = spark.createDataFrame([("abc", 3)], "x string, extra int")
    issues = {(r.level, r.column) for r in pipe.validate_raw_input(bad, require_target=True).collect()}
    assert ("error", "s") in issues and ("error", "y") in issues and ("warning", "extra") in issues
    assert ("error", "x") in issues  # text that never parses as a number


def test_score_batch_columns(spark):
    df = spark.createDataFrame([(float(i), "p" if i % 2 else "q") for i in range(40)], "x double, y string")
    pipe = Pipeline().init_from_raw(df, target="y")
    pipe.set_features(["x"])
    nb = GaussianNB().fit(df, ["x"], "y")
    assert score_batch(pipe, nb, df, keep=[]).columns == ["y", "Predicted_y", "Confidence", "Accurate"]
    # by default after all raw columns
    out = score_batch(pipe, nb, df)
    assert out.columns == ["x", "y", "Predicted_y", "Confidence", "Accurate"]


def test_stratified_counts_sum():
    alloc = sample.stratified_counts({"a": 7, "b": 11, "c": 3}, 0.25)
    assert sum(alloc.values()) == math.ceil(0.25 * 21)


def test_order_statistics_fallback_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3]], "v double")
    assert order_statistics(df, [], {(): {0, 2, 4}}) == {((), 0): 1.0, ((), 2): 3.0, ((), 4): 5.0}


def test_running_totals_handles_buckets(spark):
    vals = list(range(1, 501))
    df = spark.createDataFrame([(float(v), 1) for v in vals], "s double, c long")
    out = running_totals(df, "s", ["c"], descending=True, n_buckets=7).select("s", "cum_c").collect()
    assert {(r.s, r.cum_c) for r in out} == {(float(v), 501 - v) for v in vals}


def test_quantile_paths_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.lognormal(size=2000)
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(x)], "v double, g int")
    a = quantiles(df, ["v"], [0.1, 0.5, 0.9], group_cols=["g"], method="builtin")
    b = quantiles(df, ["v"], [0.1, 0.5, 0.9], group_cols=["g"], method="select")
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_split_result_independent_of_partitions(spark):
    df = spark.range(0, 997).withColumnRenamed("id", "k")
    a = {r.k for r in sample.split_random(df, "k", 0.3).where("split = 'test'").collect()}
    b = {r.k for r in sample.split_random(df.repartition(13), "k", 0.3).where("split = 'test'").collect()}
    assert a == b and len(a) == math.ceil(0.3 * 997)


def test_undersample_balances(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b") for i in range(100)], "k int, y string")
    out = sample.undersample(df, "k", "y")
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {"a": 30, "b": 30}


def test_frequency_encoding_unseen_zero(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    st = encode.fit_frequency(df, ["c"])
    got = dict((r[0], r[1]) for r in st.apply(spark.createDataFrame([("a",), ("z",)], "c string")).select(
        F.lit("x"), "c").collect())
    assert {r.value: r.code for r in dictionary.load(spark, st.params).collect()} == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    assert got


def test_mutual_information_independent_is_zero(spark):
    rows = [(a, b) for a in ["p", "q"] for b in ["u", "v"] for _ in range(10)]
    df = spark.createDataFrame(rows, "x string, y string")
    mi = transform.mutual_information(df, ["x"], "y").collect()[0]["mutual_info"]
    assert mi == pytest.approx(0.0, abs=1e-12)


def test_mice_recovers_linear_relation(spark):
    from tabforge.operators.mice import fit_mice
    rng = np.random.default_rng(6)
    a = rng.normal(size=400)
    b = 2.0 * a + 1.0 + rng.normal(scale=0.01, size=400)
    rows = [(i, float(x), None if i % 5 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    st = fit_mice(df, ["a", "b"], max_iter=5)
    out = {r.id: r.b for r in st.apply(df).collect()}
    for i in range(0, 400, 5):
        assert out[i] == pytest.approx(2.0 * a[i] + 1.0, abs=0.05)
    again = {r.id: r.b for r in Stage.from_json(st.to_json()).apply(df).collect()}
    assert again == out


def test_isolation_forest_flags_planted_outliers(spark):
    from tabforge.operators.iforest import isolation_forest_outliers
    rng = np.random.default_rng(7)
    pts = rng.normal(size=(1000, 2))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
    rows += [(1000 + j, 12.0 + j, -12.0 - j) for j in range(10)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    flagged, model = isolation_forest_outliers(df, ["a", "b"], ["id"], action="flag", contamination=0.01,
                                               n_trees=50)
    out = {r.id for r in flagged.where("is_outlier").collect()}
    assert set(range(1000, 1010)) <= out
    assert len(out) <= 12  # the 1% cut (ties aside)


def test_poly_kernel_map_is_exact(spark):
    from tabforge.models.kernel_svm import feature_map
    x, y = [0.3, -1.2, 2.0], [1.1, 0.4, -0.5]
    df = spark.createDataFrame([tuple(x), tuple(y)], "a double, b double, c double")
    cols = feature_map(["a", "b", "c"], "poly", gamma=0.7, degree=3)
    zs = [np.array(r) for r in df.select(*[c.alias(f"z{i}") for i, c in enumerate(cols)]).collect()]
    assert float(zs[0] @ zs[1]) == pytest.approx((0.7 * float(np.dot(x, y))) ** 3, rel=1e-12)


def test_kmeans_keeps_lowest_cost(spark):
    from tabforge.models.spark_ml import fit_kmeans
    rng = np.random.default_rng(8)
    centers = np.array([[0, 0], [10, 10], [0, 10]])
    pts = np.vstack([c + rng.normal(scale=0.5, size=(50, 2)) for c in centers])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double")
    m = fit_kmeans(df, ["a", "b"], k=3, restarts=4)
    got = sorted(tuple(np.round(c).astype(int)) for c in m.clusterCenters())
    assert got == [(0, 0), (0, 10), (10, 10)]


def test_builtin_quantile_path_for_small_inputs(spark):
    from tabforge.functions.order_stats import BUILTIN_PERCENTILE_BYTES, estimated_bytes
    df = spark.range(1000)
    assert 0 < estimated_bytes(df) <= BUILTIN_PERCENTILE_BYTES


def test_profile_approx_duplicates_close_to_exact(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_quantity", "l_discount", "l_tax")
    exact = profile.profile_table(li).collect()[0]
    approx = profile.profile_table(li, duplicates="approx").collect()[0]
    assert approx["rows"] == exact["rows"] and approx["missing_count"] == exact["missing_count"]
    distinct_exact = exact["rows"] - exact["duplicate_count"]
    distinct_approx = approx["rows"] - approx["duplicate_count"]
    assert abs(distinct_approx - distinct_exact) <= 0.05 * distinct_exact
