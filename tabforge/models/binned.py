"""Tree ensembles grown from counts.

A tree compares a feature with one of at most 31 cuts, so all rows with the same bins of all features are alike to
it: what an ensemble learns from is how many rows of each class have each combination of bins (a cell). The cuts
come from the values of all rows; one pass counts the cells, and their number is bounded by the bins, not by the
rows. A bootstrap of a cell's n rows weighs it with a Poisson(n) number, as n rows with Poisson(1) each. The trees
of a forest are dealt to tasks; the boosted trees of each class are one task. What comes out is Spark's own model,
loaded from its saved form, so predicting, saving and the importances are Spark's.
"""

from __future__ import annotations

import json
import math
import sys
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import classification as C
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, written

#: The forest's tasks, in plain local runs too, need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 32
#: Cells (bins of all features x classes) up to which the ensembles are grown from counts.
CELLS = 1 << 22
#: A feature of about so many distinct values gets its cuts from their counts, one of more from its quantiles.
VALUES = 1 << 17
EPSILON = 2.0 ** -52
NODES = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:long,gain:double,"
         "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")
NODE_TYPE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                       ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                       ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])


# ------------------------------------------------------------ cuts and cells

def cuts_of_counts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The cuts of a feature from its sorted distinct values and their counts, by the rule of Spark's trees: midway
    between neighbours, all of them or those nearest to equal shares of the rows."""
    between = (values[:-1] + values[1:]) / 2.0
    if len(between) < bins:
        return between
    cuts, stride, upto = [], counts.sum() / bins, np.cumsum(counts)
    target = stride
    for i, cut in enumerate(between):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            cuts.append(cut)
            target += stride
    return np.array(cuts)


def fit_cuts(rows: DataFrame, features: list[str], n: int) -> list[np.ndarray] | None:
    """The cuts of each feature, from all rows; None if a value is missing or not finite."""
    bins = min(MAX_BINS, n)
    shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
    found = rows.agg(*[x for i, c in enumerate(features) for x in (
        F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"bad{i}"),
        F.approx_count_distinct(c).alias(f"d{i}"), F.percentile_approx(c, shares, 10000).alias(f"q{i}"))]).first()
    if n < 2 or any(found[f"bad{i}"] for i in range(len(features))):
        return None
    cuts = []
    for i, c in enumerate(features):
        if found[f"d{i}"] > VALUES:
            cuts.append(np.unique(found[f"q{i}"]))
        else:
            at = rows.groupBy((F.col(c) + F.lit(0.0)).alias("v")).count().toArrow()
            v, k = at.column("v").to_numpy(), at.column("count").to_numpy()
            order = np.argsort(v)
            cuts.append(cuts_of_counts(v[order], k[order], bins))
    return cuts


def count_cells(rows: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], classes: int) -> DataFrame:
    """``cell`` (the bins of the features and the class as one number) and the rows ``n`` in it, written."""
    shape = [len(c) + 1 for c in cuts]
    size = math.prod(shape) * classes

    def fold(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            for i, c in enumerate(cuts):
                cell = cell * shape[i] + np.searchsorted(c, b.column(i).to_numpy(zero_copy_only=False), side="left")
            np.add.at(total, cell * classes + b.column(len(cuts)).to_numpy(zero_copy_only=False).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    counted = rows.select(*features, label).mapInArrow(fold, "cell long, n long")
    return written(counted.groupBy("cell").agg(F.sum("n").alias("n")), "cells")


class Cells:
    """The cells of a training table; ``bins`` of the combinations that occur, ``n`` of each by class."""

    def __init__(self, table: DataFrame, cuts: list[np.ndarray], classes: int):
        self.table, self.cuts, self.classes = table, cuts, classes
        self.shape = [len(c) + 1 for c in cuts]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.table.toArrow()
        cell, n = at.column("cell").to_numpy(), at.column("n").to_numpy()
        group, where = np.unique(cell // self.classes, return_inverse=True)
        by_class = np.zeros((len(group), self.classes), np.int64)
        by_class[where, cell % self.classes] = n
        bins = np.stack(np.unravel_index(group, self.shape)).astype(np.uint8)
        return bins, by_class

    def _inside(self, number: Column) -> Column:
        """A vector inside the bins of a combination."""
        x = []
        for i in reversed(range(len(self.shape))):
            cuts = self.cuts[i].tolist()
            inside = [*cuts, float(np.nextafter(cuts[-1], np.inf)) if cuts else 0.0]
            x.append(F.element_at(F.array(*[F.lit(v) for v in inside]), (number % self.shape[i] + 1).cast("int")))
            number = F.floor(number / self.shape[i])
        return array_to_vector(F.array(*reversed(x))).alias("__features")

    def rows(self) -> DataFrame:
        """A vector for each combination that occurs, with its classes and their numbers of rows (``__each``)."""
        each = F.struct((F.col("cell") % self.classes).cast("double").alias("label"), F.col("n").cast("double").alias("n"))
        by = self.table.groupBy(F.floor(F.col("cell") / self.classes).alias("__bins")).agg(F.collect_list(each).alias("__each"))
        return by.select(self._inside(F.col("__bins")), "__each")

    def grid(self) -> DataFrame:
        """A vector for each combination there can be, with its number ``__bins``."""
        return self.table.sparkSession.range(math.prod(self.shape)).select(F.col("id").alias("__bins"), self._inside(F.col("id")))


def bins_of(rows: DataFrame, vector: str, cuts: list[np.ndarray]) -> DataFrame:
    """``rows`` with the number of their combination as ``__bins``."""
    x = vector_to_array(vector)
    some = [i for i, c in enumerate(cuts) if len(c)]
    names = [f"__x{i}" for i in some]
    above = [[-math.inf, *np.nextafter(cuts[i], np.inf).tolist(), math.inf] for i in some]  # its bins hold their lower end, those of a tree their upper
    out = rows.withColumns({n: x[i] for n, i in zip(names, some)})
    if some:
        out = Bucketizer(splitsArray=above, inputCols=names, outputCols=[f"{n}b" for n in names]).transform(out)
    number = F.lit(0).cast("long")
    for i, c in enumerate(cuts):
        number = number * (len(c) + 1) + (F.col(f"__x{i}b").cast("long") if len(c) else 0)
    return out.select(*rows.columns, number.alias("__bins"))


def cells_of(rows: DataFrame, features: list[str], label: str, classes: int, n: int) -> Cells | None:
    """The cells of a table with numeric ``features`` and the class index ``label``; None if a value is missing
    or not finite, or if there may be more than ``CELLS``."""
    cuts = fit_cuts(rows, features, n)
    if cuts is None or math.prod(len(c) + 1 for c in cuts) * classes > CELLS:
        return None
    return Cells(count_cells(rows, features, label, cuts, classes), cuts, classes)


# ------------------------------------------------------------ growing a tree

def _gini(by_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = by_class.sum(axis=-1)
    return n, 1.0 - (by_class * by_class).sum(axis=-1) / np.maximum(n, 1.0) ** 2


def _variance(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(sums[..., 0], 1.0)
    return sums[..., 0], (sums[..., 2] - sums[..., 1] * sums[..., 1] / n) / n


def grow(bins: np.ndarray, stats: np.ndarray, shape: list[int], impurity, depth: int, least: int, draw=None):
    """One tree, level by level. ``bins``: features x cells; ``stats``: cells x what ``impurity`` takes the (added up)
    numbers of; ``draw(nodes)``: which features the nodes of a level may split on. Returns the nodes, children after
    their parent (stats, feature, bin, gain, left), and the node of each cell."""
    k = stats.shape[1]
    nodes = [stats.sum(axis=0)[None]]
    split: list[tuple[np.ndarray, ...]] = []
    leaf_of = np.zeros(bins.shape[1], np.int64)
    rows, at, first = np.arange(bins.shape[1]), np.zeros(bins.shape[1], np.int64), 0
    columns = [np.ascontiguousarray(stats[:, j]) for j in range(k)]
    for level in range(depth + 1):
        total = nodes[-1]
        m = len(total)
        gain, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        if level < depth and m:
            n, own = impurity(total)
            may = draw(m) if draw else None
            for f, b in enumerate(shape):
                if b < 2:
                    continue
                key = at * b + bins[f, rows]
                left = np.stack([np.bincount(key, c[rows], m * b).reshape(m, b) for c in columns], axis=-1).cumsum(axis=1)[:, :-1]
                right = total[:, None] - left
                (ln, li), (rn, ri) = impurity(left), impurity(right)
                gains = own[:, None] - ln / n[:, None] * li - rn / n[:, None] * ri
                gains[(ln < least) | (rn < least)] = -1.0
                if may is not None:
                    gains[~may[:, f]] = -1.0
                best = gains.argmax(axis=1)
                top = gains[np.arange(m), best]
                better = top > gain
                gain[better], feature[better], cut[better] = top[better], f, best[better]
            feature[own < EPSILON] = -1
        inner = feature >= 0
        number = np.cumsum(inner) - 1
        split.append((feature, cut, np.where(inner, gain, -1.0), np.where(inner, first + m + 2 * number, -1)))
        leaf_of[rows] = first + at
        first += m
        if not inner.any():
            break
        go = inner[at]
        rows, at = rows[go], at[go]
        right_side = bins[feature[at], rows] > cut[at]
        at = 2 * number[at] + right_side
        m = 2 * int(inner.sum())
        nodes.append(np.stack([np.bincount(at, c[rows], m) for c in columns], axis=-1))
    return (np.concatenate(nodes), *(np.concatenate(x) for x in zip(*split))), leaf_of


def _preorder(tree, prediction: np.ndarray):
    """Numbers of the nodes in the order of Spark's saved trees and the left child of each (-1: a leaf); two leaves
    that predict the same are taken back into their parent."""
    left = tree[4].copy()
    for i in range(len(left) - 1, -1, -1):
        a = left[i]
        if a >= 0 and left[a] < 0 and left[a + 1] < 0 and prediction[a] == prediction[a + 1]:
            left[i] = -1
    order, todo = [], [0]
    while todo:
        i = todo.pop()
        order.append(i)
        if left[i] >= 0:
            todo += [left[i] + 1, left[i]]
    return np.array(order), left


def node_batch(number: int, tree, cuts: list[np.ndarray], prediction: np.ndarray, impurity) -> pa.RecordBatch:
    """A tree as the rows of its saved form."""
    order, left = _preorder(tree, prediction)
    stats, feature, cut, gain, _ = (x[order] for x in tree)
    child = left[order]
    inner = child >= 0
    place = np.full(len(left), -1)
    place[order] = np.arange(len(order))
    n, own = impurity(stats)
    threshold = [cuts[f][b] for f, b in zip(feature[inner], cut[inner])]
    split = pa.StructArray.from_arrays(
        [pa.array(np.where(inner, feature, -1), pa.int32()),
         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inner)]), pa.int32()), pa.array(threshold, pa.float64())),
         pa.array(np.full(len(order), -1), pa.int32())], fields=list(NODE_TYPE.field("split").type))
    nodes = pa.StructArray.from_arrays(
        [pa.array(np.arange(len(order)), pa.int32()), pa.array(prediction[order], pa.float64()), pa.array(np.maximum(own, 0.0)),
         pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel())),
         pa.array(n.astype(np.int64)), pa.array(np.where(inner, gain, -1.0)), pa.array(np.where(inner, place[child], -1), pa.int32()),
         pa.array(np.where(inner, place[np.minimum(child + 1, len(left) - 1)], -1), pa.int32()), split], fields=list(NODE_TYPE))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(order), number), pa.int32()), nodes], names=["treeID", "nodeData"])


def _load(estimator, kind, tree_class: str, nodes: DataFrame, weights: list[float], **numbers):
    """Spark's model of ``kind`` from the nodes of its trees."""
    spark = nodes.sparkSession
    path = scratch_path(spark, "trees")
    name = lambda p: {k.name: v for k, v in p.items()}
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    params = name(estimator._paramMap)
    spark_class = "org.apache.spark.ml."
    whole = {"class": f"{spark_class}classification.{kind.__name__}", **head, "uid": f"{kind.__name__}_{uuid.uuid4().hex[:12]}", "paramMap": params,
             "defaultParamMap": name(estimator._defaultParamMap), **numbers}
    own = {k: v for k, v in params.items() if k in ("featuresCol", "labelCol", "maxDepth", "minInstancesPerNode", "maxMemoryInMB")}
    tree = [json.dumps({"class": spark_class + tree_class, **head, "uid": f"tree_{uuid.uuid4().hex[:12]}", "paramMap": own,
                        "defaultParamMap": {}}) for _ in weights]
    nodes.write.parquet(f"{path}/data")
    spark.createDataFrame([(i, t, float(w)) for i, (t, w) in enumerate(zip(tree, weights))], "_1 int, _2 string, _3 double").coalesce(1) \
        .write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return kind.load(path)


# ------------------------------------------------------------ ensembles

def fit_forest(cells: Cells, estimator: C.RandomForestClassifier) -> C.RandomForestClassificationModel:
    """What ``estimator`` would fit to the rows of the cells, with random numbers of its own: each tree has the
    cells weighed anew and draws the features of a node from the square root of their number."""
    spark, cuts, shape, classes = cells.table.sparkSession, cells.cuts, cells.shape, cells.classes
    trees, depth, seed = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    least, bootstrap, d = estimator.getMinInstancesPerNode(), estimator.getBootstrap(), len(cells.cuts)
    of = d if trees == 1 else math.ceil(math.sqrt(d))
    held = spark.sparkContext.broadcast(cells.arrays())

    def fold(batches):
        bins, by_class = held.value
        for b in batches:
            for number in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, number])

                def draw(nodes):
                    may = np.zeros((nodes, d), bool)
                    np.put_along_axis(may, rng.random((nodes, d)).argsort(axis=1)[:, :of], True, axis=1)
                    return may

                weights = rng.poisson(by_class) if bootstrap else by_class
                some = weights.any(axis=1)
                tree, _ = grow(bins[:, some], weights[some].astype(float), shape, _gini, depth, least, draw)
                yield node_batch(number, tree, cuts, tree[0].argmax(axis=1).astype(float), _gini)

    nodes = spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(fold, NODES)
    return _load(estimator, C.RandomForestClassificationModel, "classification.DecisionTreeClassificationModel", nodes, [1.0] * trees,
                 numFeatures=d, numClasses=classes, numTrees=trees)


def fit_boosted(cells: Cells, estimator: C.GBTClassifier) -> list[C.GBTClassificationModel]:
    """What ``estimator`` would fit to the rows of the cells: a model of each class against the rest, or of the second
    of two classes. All rows of a cell have one prediction, so the residuals are those of its positive and negative rows."""
    spark, cuts, shape, classes = cells.table.sparkSession, cells.cuts, cells.shape, cells.classes
    trees, depth, rate, least = estimator.getMaxIter(), estimator.getMaxDepth(), estimator.getStepSize(), estimator.getMinInstancesPerNode()
    held = spark.sparkContext.broadcast(cells.arrays())
    targets = range(classes) if classes > 2 else range(1, 2)

    def fold(batches):
        bins, by_class = held.value
        total = by_class.sum(axis=1).astype(float)
        for b in batches:
            for target in b.column(0).to_pylist():
                pos = by_class[:, target].astype(float) if target < classes else np.zeros(len(total))
                neg, at = total - pos, np.zeros(len(total))
                up, down = np.ones(len(total)), -np.ones(len(total))
                for number in range(trees):
                    stats = np.stack([total, pos * up + neg * down, pos * up * up + neg * down * down], axis=1)
                    tree, leaf = grow(bins, stats, shape, _variance, depth, least)
                    prediction = tree[0][:, 1] / tree[0][:, 0]
                    at += (rate if number else 1.0) * prediction[leaf]
                    up, down = 4.0 / (1.0 + np.exp(2.0 * at)), -4.0 / (1.0 + np.exp(-2.0 * at))
                    yield node_batch(target * trees + number, tree, cuts, prediction, _variance)

    nodes = written(spark.range(targets.start, targets.stop, 1, len(targets)).mapInArrow(fold, NODES), "boosted")
    weights = [1.0] + [rate] * (trees - 1)
    own = F.col("treeID").between
    return [_load(estimator, C.GBTClassificationModel, "regression.DecisionTreeRegressionModel",
                  nodes.where(own(t * trees, t * trees + trees - 1)).withColumn("treeID", (F.col("treeID") - t * trees).cast("int")),
                  weights, numFeatures=len(cuts), numTrees=trees) for t in targets]
