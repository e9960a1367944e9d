"""Exact neighbour search and what rests on it, against brute force: a hot cell, equal points, ties, missing
features, extra columns, empty tables."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.models.knn import NeighborModel
from tabforge.operators import impute, knn_impute, neighbors, sample
from tabforge.plans.stage import Stage

RND = random.Random(4)
# a third of the points lie at one place, another third in a small range
POINTS = ([(i, RND.gauss(0, 1), RND.gauss(0, 5), float(RND.randint(0, 3)), i % 7) for i in range(600)]
          + [(1000 + i, 0.5, 0.5, 1.0, 3) for i in range(600)] + [(2000 + i, 0.5 + 1e-6 * RND.random(), 0.5, 1.0, 2) for i in range(600)]
          + [(9000, None, 1.0, 1.0, 0), (9001, float("nan"), 1.0, 1.0, 0)])
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(*p, "x", 0.0) for p in POINTS], "pid long, a double, b double, c double, v long, vec string, cell double").repartition(5)


def brute(q, k, leave=None):
    rows = [p for p in POINTS if p[1] is not None and p[1] == p[1]]
    x, ids = np.array([p[1:4] for p in rows]), np.array([p[0] for p in rows])
    d = np.zeros(len(x))
    for j in range(3):
        d += (q[1 + j] - x[:, j]) ** 2
    return [(float(np.sqrt(d[i])), int(ids[i]), rows[i][4]) for i in np.lexsort((ids, d)) if ids[i] != leave][:k]


@pytest.mark.parametrize("k,exclude,leaf_rows", [(1, False, 40), (5, True, 40), (9, False, 10 ** 6), (3000, False, 100)])
def test_nearest_equals_brute_force(points, k, exclude, leaf_rows):
    asked = points.where("pid % 9 = 0")
    got = {r.id: [tuple(n) for n in r.neighbors] for r in neighbors.nearest(asked, points, FEATURES, k, "pid", "pid", "v", exclude, leaf_rows).collect()}
    want = [p for p in POINTS if p[0] % 9 == 0 and p[1] is not None and p[1] == p[1]]
    assert set(got) == {p[0] for p in want}
    for p in want:
        full = brute(p, k if k < 100 else 10 ** 6, p[0] if exclude else None)
        if k < 100:
            assert got[p[0]] == full
        else:  # fewer points than k: all of them
            assert got[p[0]] == full and len(full) < k


def test_many_queries_of_one_cell_are_shared_out(points, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERIES_PER_TASK", 100)
    out = neighbors.nearest(points, points, FEATURES, 2, "pid", "pid", "v", leaf_rows=200)
    got = {r.id: [tuple(n) for n in r.neighbors] for r in out.collect()}
    for p in POINTS[::97]:
        assert got[p[0]] == brute(p, 2)


def test_no_pairing_of_all_rows_in_the_plan(points, capsys):
    neighbors.nearest(points, points, FEATURES, 2, "pid", "pid", leaf_rows=200).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_of_nothing(spark, points):
    none = points.where("pid < 0")
    assert neighbors.nearest(none, points, FEATURES, 3, "pid", "pid").collect() == []
    assert [r.neighbors for r in neighbors.nearest(points.where("pid = 1"), none, FEATURES, 3, "pid", "pid").collect()] in ([], [[]])


def test_text_ids(spark):
    p = spark.createDataFrame([("b", 0.0), ("a", 0.0), ("c", 1.0)], "name string, x double")
    got = {r.id: [n.id for n in r.neighbors] for r in neighbors.nearest(p, p, ["x"], 2, "name", "name").collect()}
    assert got == {"a": ["a", "b"], "b": ["a", "b"], "c": ["c", "a"]}


def test_tree_cells_hold_every_point_and_boxes_bound_them():
    x = np.random.default_rng(1).normal(size=(3000, 4))
    x[:1000] = 0.25
    tree = neighbors.Tree(x[::3], 32)
    cells = tree.cells(x)
    assert 1 < tree.leaves <= 32 and cells.min() >= 0 and cells.max() < tree.leaves
    low, high = (np.array([f(x[cells == c], axis=0) for c in range(tree.leaves)]) for f in (np.min, np.max))
    d = neighbors.box_distances(x[:50], low, high)
    exact = neighbors.squared_distances(x[:50], x)
    for c in range(tree.leaves):
        assert (d[:, c] <= exact[:, cells == c].min(axis=1) + 1e-12).all()


def test_classifier_votes_and_ties(spark):
    train = spark.createDataFrame([(1, 0.0, "b"), (2, 0.1, "a"), (3, 0.2, "b"), (4, 0.3, "a"), (5, 9.0, "c"), (6, 1.0, None)], "k long, x double, y string")
    m = NeighborModel("clf_knn", {"n_neighbors": 4}).fit(train, ["x"], "y", "k")
    test = spark.createDataFrame([(1, 0.05), (2, 8.9), (3, None)], "k long, x double")
    got = {r.k: r for r in m.transform(test, key="k").collect()}
    assert got[1].prediction == "a" and got[1].confidence == 0.5 and got[1].probability == [0.5, 0.5, 0.0]  # two of each: the smaller class
    assert got[3].prediction is None and sum(got[2].probability) == pytest.approx(1)
    assert [r.prediction for r in m.transform(test.where("k = 1")).collect()] == ["a"]
    r = NeighborModel("reg_knn", {"n_neighbors": 2}).fit(train.withColumn("y", F.col("k") * 1.0), ["x"], "y", "k")
    assert [x.prediction for x in r.transform(test.where("k = 1"), key="k").collect()] == [1.5]


def test_knn_imputation_by_pattern(spark):
    rows = [(1, 1.0, 10.0, None), (2, 1.5, None, 5.0), (3, None, 11.0, 6.0), (4, 9.0, 50.0, 7.0), (5, None, None, None), (6, float("nan"), 10.5, None), (7, 2.0, 12.0, 9.0)]
    d = spark.createDataFrame([(*r, "keep") for r in rows], "k long, a double, b double, c double, t string").repartition(3)
    out, stage = impute.impute(d, ["a", "b", "c"], "knn", n_neighbors=2, key="k")
    got = {r.k: (r.a, r.b, r.c) for r in out.collect()}
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])

    def want(i):
        new = list(x[i])
        for j in range(3):
            if np.isnan(x[i, j]):
                found = []
                for g in range(len(x)):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[g])
                    if not np.isnan(x[g, j]) and both.any():
                        found.append((3 / both.sum() * ((x[i] - x[g])[both] ** 2).sum(), rows[g][0], x[g, j]))
                new[j] = np.mean([v for *_, v in sorted(found)[:2]]) if found else np.nanmean(x[:, j])
        return new

    for i, r in enumerate(rows):
        assert got[r[0]] == pytest.approx(want(i))
    assert out.columns == d.columns and out.count() == len(rows)
    again = Stage.from_json(stage.to_json()).apply(d.where("k in (5, 6)"))
    assert sorted(r.k for r in again.collect()) == [5, 6]
    with pytest.raises(ValueError):
        knn_impute._apply_knn_impute(d.drop("a"), stage.params)


def test_single_column_neighbours_are_the_mean(spark):
    d = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    out, _ = impute.impute(d, ["a"], "knn")
    assert sorted(r.a for r in out.collect()) == [1.0, 2.0, 3.0]


def test_smote_evens_the_classes(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1), "big") for i in range(50)] + [(100 + i, rnd.gauss(9, 1), 5.0, "mid") for i in range(9)]
    rows += [(200 + i, float(i), -9.0, "few") for i in range(4)] + [(300, 1.0, 1.0, None), (301, None, 1.0, "mid")]
    d = spark.createDataFrame(rows, "k long, x double, y double, cls string")
    out = sample.smote(d, "k", "cls", ["x", "y"])
    assert {r.cls: r["count"] for r in out.groupBy("cls").count().collect()} == {"big": 50, "mid": 50, "few": 50}
    few = [r for r in out.where("cls = 'few'").collect()]
    assert all(r.y == -9.0 and 0 <= r.x <= 3 for r in few)  # between rows of the class
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sample.smote(d.repartition(7), "k", "cls", ["x", "y"]).collect()))
    with pytest.raises(ValueError):
        sample.smote(d.where("cls = 'few'"), "k", "cls", ["x", "y"])
    with pytest.raises(ValueError):
        sample.smote(d.where("k < 51 or k = 100"), "k", "cls", ["x", "y"])


def test_balance_table(spark):
    d = spark.createDataFrame([(1, 2.0, "a", "x"), (2, 3.0, None, "y")], "k long, x double, cls string, note string")
    out = sample.balance_table(d, "cls", exclude=["k"])
    assert out.columns == ["x", "cls"] and out.count() == 1
