"""Isolation forest on Spark: trees grown in parallel on bounded samples, scored with a
vectorised pandas UDF, cut at an exact score quantile.

1. A Bernoulli pre-sample by row hash keeps about ``oversample * n_trees * max_samples`` complete
   rows (a bound independent of the table size).
2. Each tree takes the ``max_samples`` rows of that pre-sample with the smallest md5(key|seed|tree)
   (a window partitioned by tree over the bounded pre-sample).
3. ``groupBy(tree).applyInPandas`` grows one isolation tree per group (random feature, random
   split between the node's min and max, depth limit ceil(log2(max_samples))).
4. The trees (at most n_trees x (2 * max_samples - 1) nodes) are shipped to a pandas UDF that
   walks all of them for a whole Arrow batch at once and returns the anomaly score
   2^(-E[h(x)] / c(max_samples)).
5. Rows scoring above the (1 - contamination) quantile of the scores are the outliers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import missing, seeded_hash
from ..functions.order_stats import quantiles
from ..session import written

EULER = 0.5772156649015329


def c_factor(n):
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int):
    """Nodes as rows: (node, feature, threshold, left, right, size, depth); leaves have feature -1."""
    nodes = []

    def build(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        sub = points[idx]
        if depth >= limit or len(idx) <= 1:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[nid] = (nid, f, thr, left, right, len(idx), depth)
        return nid

    build(np.arange(len(points)), 0)
    return nodes


def fit_isolation_forest(df: DataFrame, cols: list[str], key_cols: list[str], n_trees: int = 100,
                         max_samples: int = 256, contamination: float = 0.05, seed: int = 42,
                         oversample: float = 2.0) -> dict:
    """Returns the fitted forest: trees (plain lists), column list, sample size, score cut."""
    complete = df
    for c in cols:
        complete = complete.where(~missing(df, c))
    n = complete.count()
    if n <= 10:
        raise ValueError("isolation forest needs more than 10 complete rows")
    psi = min(max_samples, n)
    frac = min(1.0, oversample * n_trees * psi / n)
    u = F.conv(F.substring(seeded_hash(key_cols, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)
    pre = complete.where(u < F.lit(frac)).select(*key_cols, *[F.col(c).cast("double").alias(c) for c in cols])
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("__tree")
    per_tree = pre.select("*", trees)
    per_tree = per_tree.withColumn("__h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols],
                                                            F.lit(str(seed)), F.col("__tree").cast("string"))))
    w = Window.partitionBy("__tree").orderBy("__h")
    chosen = per_tree.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= psi).drop("__r", "__h")
    limit = int(math.ceil(math.log2(max(psi, 2))))
    d = len(cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["__tree"].iloc[0])
        pts = pdf[cols].to_numpy(dtype=float)
        nodes = _grow(pts, np.random.default_rng(seed * 100_003 + t), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", t)
        return out

    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
                           T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
                           T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
                           T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType())])
    node_rows = chosen.groupBy("__tree").applyInPandas(grow, schema).collect()  # bounded: trees x nodes
    forest = {}
    for r in node_rows:
        forest.setdefault(r["tree"], []).append((r["node"], r["feature"], r["threshold"], r["left"], r["right"],
                                                 r["size"], r["depth"]))
    model = {"cols": list(cols), "psi": psi, "d": d,
             "trees": [sorted(forest[t]) for t in sorted(forest)], "cut": None}
    # the quantile takes several passes: the scores are written, so that the trees are walked once for all of them
    scored = written(score_isolation_forest(complete.select(*cols), model).select("anomaly_score"), "forest-scores")
    q = quantiles(scored, ["anomaly_score"], [1.0 - contamination])
    model["cut"] = q[("anomaly_score", (), 1.0 - contamination)]
    return model


def _tree_arrays(tree):
    a = np.array([(f, thr, l, r, s, dep) for (_n, f, thr, l, r, s, dep) in tree], dtype=float)
    return (a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int),
            a[:, 5] + c_factor(a[:, 4]))


def score_isolation_forest(df: DataFrame, model: dict, out: str = "anomaly_score") -> DataFrame:
    """Adds the anomaly score in [0, 1] (higher = more isolated), computed per Arrow batch."""
    arrays = [_tree_arrays(t) for t in model["trees"]]
    denom = float(c_factor(np.array([model["psi"]]))[0]) or 1.0
    cols = model["cols"]

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in xs])
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feat, thr, left, right, leaf_len in arrays:
            node = np.zeros(len(x), dtype=int)
            while True:
                f = feat[node]
                inner = f >= 0
                if not inner.any():
                    break
                fi = np.where(inner, f, 0)
                go_left = x[rows, fi] < thr[node]
                node = np.where(inner, np.where(go_left, left[node], right[node]), node)
            total += leaf_len[node]
        return pd.Series(np.power(2.0, -(total / len(arrays)) / denom))

    return df.withColumn(out, score(*[F.col(c).cast("double") for c in cols]))


def isolation_forest_outliers(df: DataFrame, cols: list[str], key_cols: list[str], action: str = "flag",
                              **kw) -> tuple[DataFrame, dict]:
    """flag: adds ``is_outlier`` (rows with a missing feature are never flagged); remove: drops them."""
    model = fit_isolation_forest(df, cols, key_cols, **kw)
    complete = F.lit(True)
    for c in cols:
        complete = complete & ~missing(df, c)
    scored = score_isolation_forest(df, model)
    flagged = scored.withColumn("is_outlier", complete & (F.col("anomaly_score") > F.lit(model["cut"])))
    if action == "remove":
        return flagged.where(~F.col("is_outlier")).drop("is_outlier", "anomaly_score"), model
    return flagged, model
