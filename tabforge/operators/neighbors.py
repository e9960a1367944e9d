"""Exact k nearest neighbours by Euclidean distance, without pairing all rows.

Points are put into cells of a k-d tree: recursive range splits at medians of a bounded sample, at
most ``max_leaves`` leaves, so the tree and the cells' bounding boxes have a fixed size limit. The
search takes two passes, each a cogroup of queries and points by cell: pass one compares a query
with its own cell, which gives an upper bound on the k-th distance; pass two visits only cells whose
box is no farther than that bound. The result is the same as of a comparison with every point.

Skew: of equal points only the ``k`` with the smallest ids can matter, so the others are dropped by a
group limit before the shuffle; a cell that many queries visit is dealt to several tasks, with a
copy of its points for each.

Points with a missing feature are nobody's neighbours; a query with one has none. Ties in distance go to the
smaller id. Ids must be unique within their table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import number
from ..session import written

LEAF_ROWS = 2000
MAX_LEAVES = 4096
SAMPLE_PER_LEAF = 32
#: Queries that one task compares with a cell.
QUERIES_PER_TASK = 50_000
_PAIRS = 1 << 21  # distances held at a time


class Tree:
    """Range splits: inner node ``i`` sends rows with ``x[dim[i]] < cut[i]`` to ``low[i]``, others to
    ``high[i]``; a child below zero is leaf ``-child - 1``."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.low, self.high, self.leaves = [], [], [], [], 0
        self.root = self._grow(sample, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(x) > 1:
            spread = np.ptp(x, axis=0)
            d = int(np.argmax(spread))
            if spread[d] > 0:
                v = np.sort(x[:, d])
                cut = v[len(v) // 2]
                if cut == v[0]:
                    cut = v[np.searchsorted(v, cut, side="right")]
                node = len(self.dim)
                for a, b in ((self.dim, d), (self.cut, float(cut)), (self.low, 0), (self.high, 0)):
                    a.append(b)
                left = x[:, d] < cut
                self.low[node] = self._grow(x[left], leaves // 2)
                self.high[node] = self._grow(x[~left], leaves - leaves // 2)
                return node
        self.leaves += 1
        return -self.leaves

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        dim, cut, low, high = (np.array(a) for a in (self.dim, self.cut, self.low, self.high))
        at = np.flatnonzero(node >= 0)
        while len(at):
            n = node[at]
            node[at] = np.where(x[at, dim[n]] < cut[n], low[n], high[n])
            at = at[node[at] >= 0]
        return -node - 1


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Feature by feature, in order, so that the sums are those of plain SQL."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += (q[:, j, None] - x[None, :, j]) ** 2
    return out


def pair_distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for the pairs (``i``, ``j``) alone."""
    out = np.zeros(len(i))
    for c in range(q.shape[1]):
        out += (q[i, c] - x[j, c]) ** 2
    return out


def rough_distances(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances as one matrix product, and for each query by how much any of them may be off: who is
    surely farther need not be compared feature by feature."""
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    room = 1e-14 * (q.shape[1] + 8) * (qq + xx.max())
    if not np.isfinite(room).all():
        return squared_distances(q, x), np.zeros(len(q))
    return qq[:, None] + xx[None, :] - 2 * (q @ x.T), room


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to the nearest place of each box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        out += np.maximum(0, np.maximum(low[None, :, j] - q[:, j, None], q[:, j, None] - high[None, :, j])) ** 2
    return out


def _with_cells(df: DataFrame, tree, width: int) -> DataFrame:
    def run(batches):
        t = tree.value
        for b in batches:
            yield b.append_column("cell", pa.array(t.cells(_matrix(b.column("vec"), width)).astype(np.int32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, cell int")


def _vectors(df: DataFrame, features: list[str], keep: dict) -> DataFrame:
    ok = F.lit(True)
    for c in features:
        ok = ok & number(c).isNotNull()
    vec = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])
    return df.where(ok).select(*[c.alias(n) for n, c in keep.items()], vec.alias("vec"))


def _compared(pairs: DataFrame, points: DataFrame, k: int, width: int, exclude_self: bool) -> DataFrame:
    """(id, own, vec, found): for each pair of a query and a cell the ``k`` nearest points of the cell
    within the query's bound, as (d2, id, value)."""
    counts = {r.cell: r["count"] for r in pairs.groupBy("cell").count().collect()}  # at most a row for each leaf
    shares = {c: math.ceil(n / QUERIES_PER_TASK) for c, n in counts.items() if n > QUERIES_PER_TASK}
    if shares:
        n = F.coalesce(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("cell")], F.lit(1))
        pairs = pairs.withColumn("share", F.pmod(F.hash("id"), n).cast("int"))
        points = points.withColumn("share", F.explode(F.sequence(F.lit(0), n - 1)))
    else:
        pairs, points = pairs.withColumn("share", F.lit(0)), points.withColumn("share", F.lit(0))
    found = f"array<struct<d2: double, id: {dict(points.dtypes)['pid']}, value: {dict(points.dtypes)['value']}>>"
    id_type = dict(pairs.dtypes)["id"]

    def run(key, q: pa.Table, x: pa.Table) -> pa.Table:
        x = x.take(pc.sort_indices(x, sort_keys=[("pid", "ascending")]))
        xs, qs = _matrix(x.column("vec"), width) if len(x) else np.zeros((0, width)), _matrix(q.column("vec"), width)
        bounds = q.column("bound").to_numpy()
        place = {v: i for i, v in enumerate(x.column("pid").to_pylist())} if exclude_self else {}
        rows, cols, dist = [], [], []
        for a in range(0, len(qs), max(1, _PAIRS // max(1, len(xs)))):
            part = qs[a:a + max(1, _PAIRS // max(1, len(xs)))]
            if not len(xs):
                break
            near, room = rough_distances(part, xs)
            if exclude_self:
                for i, v in enumerate(q.column("id").slice(a, len(part)).to_pylist()):
                    if v in place:
                        near[i, place[v]] = np.inf
            m = min(k, len(xs)) - 1
            most = np.minimum(np.partition(near, m, axis=1)[:, m] + 2 * room, bounds[a:a + len(part)] + room)
            i, j = np.nonzero((near <= most[:, None]) & np.isfinite(near))
            d2 = pair_distances(part, xs, i, j)
            by = np.lexsort((j, d2, i))
            by = by[(d2[by] <= bounds[a:a + len(part)][i[by]]) & np.isfinite(d2[by])]
            i, j, d2 = i[by], j[by], d2[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            rows.append(i[rank < k] + a)
            cols.append(j[rank < k])
            dist.append(d2[rank < k])
        rows, cols, dist = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((rows, np.int64), (cols, np.int64), (dist, float)))
        at = pa.array(cols.astype(np.int64))
        items = pa.StructArray.from_arrays([pa.array(dist), x.column("pid").combine_chunks().take(at), x.column("value").combine_chunks().take(at)],
                                           names=["d2", "id", "value"])
        offsets = np.searchsorted(rows, np.arange(len(qs) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), items)
        return pa.table({"id": q.column("id"), "own": q.column("cell"), "vec": q.column("vec"), "found": lists})

    # comparing takes time, not bytes: a task gets one cell and share or a few, however few bytes they are
    total = sum(shares.get(c, 1) for c in counts)
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(total, MAX_LEAVES))
    if total > 1:
        pairs, points = (t.repartition(tasks, "cell", "share") for t in (pairs, points))
    both = pairs.groupBy("cell", "share").cogroup(points.groupBy("cell", "share"))
    return both.applyInArrow(run, f"id {id_type}, own int, vec array<double>, found {found}")


def nearest(queries: DataFrame, points: DataFrame, features: list[str], k: int, query_id: str, point_id: str, value: str | None = None,
            exclude_self: bool = False, leaf_rows: int = LEAF_ROWS, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(id, neighbors): for each query the ``k`` nearest points as an array of (distance, id, value),
    nearest first. ``value``: a column of the points to bring along. ``exclude_self``: a point with the
    query's own id is none of its neighbours. Fewer points than ``k``: all of them."""
    out = nearest_squared(queries, points, features, k, query_id, point_id, value, exclude_self, leaf_rows, max_leaves)
    pick = F.transform("found", lambda s: F.struct(F.sqrt(s["d2"]).alias("distance"), s["id"].alias("id"), s["value"].alias("value")))
    return out.select("id", pick.alias("neighbors"))


def nearest_squared(queries: DataFrame, points: DataFrame, features: list[str], k: int, query_id: str, point_id: str, value: str | None = None,
                    exclude_self: bool = False, leaf_rows: int = LEAF_ROWS, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(id, found): the same with squared distances, as an array of (d2, id, value)."""
    spark, width = points.sparkSession, len(features)
    x = _vectors(points, features, {"pid": F.col(point_id), "value": F.col(value) if value else F.lit(None).cast("boolean")})
    equal = Window.partitionBy("vec").orderBy("pid")
    x = written(x.withColumn("rn", F.row_number().over(equal)).where(F.col("rn") <= k + int(exclude_self)).drop("rn"), "neighbor-points")
    n = x.count()
    leaves = min(max_leaves, max(1, n // leaf_rows))
    want = SAMPLE_PER_LEAF * leaves
    sample = x.select("vec").sample(min(1.0, 1.5 * want / n), seed=7).limit(2 * want).collect() if leaves > 1 else []
    tree = spark.sparkContext.broadcast(Tree(np.array([r.vec for r in sample]).reshape(-1, width), leaves))
    x = _with_cells(x, tree, width)
    q = _with_cells(_vectors(queries, features, {"id": F.col(query_id)}), tree, width)
    first = written(_compared(q.withColumn("bound", F.lit(float("inf"))), x, k, width, exclude_self), "neighbor-first")
    if leaves == 1:
        found = first.select("id", "found")
    else:
        edges = x.groupBy("cell").agg(F.array(*[F.min(F.col("vec")[j]) for j in range(width)]).alias("lo"),
                                      F.array(*[F.max(F.col("vec")[j]) for j in range(width)]).alias("hi")).collect()
        boxes = spark.sparkContext.broadcast([np.array([getattr(r, c) for r in edges]) for c in ("cell", "lo", "hi")])
        pairs = written(_farther(first, boxes, k, width), "neighbor-pairs")
        second = _compared(pairs, x, k, width, exclude_self)
        found = first.select("id", "found").unionByName(second.select("id", "found"))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k)
    return found.groupBy("id").agg(best.alias("found"))


def _farther(first: DataFrame, boxes, k: int, width: int) -> DataFrame:
    """(id, vec, bound, cell): the other cells that may hold a nearer point of each query."""
    kind = dict(first.dtypes)["id"]

    def run(batches):
        cells, low, high = boxes.value
        for batch in batches:
            step = max(1, _PAIRS // len(cells))
            for a in range(0, batch.num_rows, step):
                b = batch.slice(a, step)
                found = b.column("found").to_pylist()
                # a little room, as a box distance is rounded on its own
                bound = np.array([f[k - 1]["d2"] if len(f) >= k else np.inf for f in found])
                near = box_distances(_matrix(b.column("vec"), width), low, high) <= bound[:, None] * (1 + 1e-9)
                near &= cells[None, :] != b.column("own").to_numpy(zero_copy_only=False)[:, None]
                i, j = np.nonzero(near)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("vec").take(at), pa.array(bound[i]), pa.array(cells[j].astype(np.int32))],
                                                 names=["id", "vec", "bound", "cell"])

    return first.mapInArrow(run, f"id {kind}, vec array<double>, bound double, cell int")
