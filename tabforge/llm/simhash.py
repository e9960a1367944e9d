"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the XXH64 values (seed 42) of
the text's ``shingle``-word shingles, repeats included. Fingerprints with at most ``max_bits``
differing bits are linked; documents are grouped by reachability.

Search: equal fingerprints are one node. With at most ``max_bits`` differences, one of
``max_bits + 1`` blocks of bits is equal, so every node goes to a bucket for each block's value
and all links meet in some bucket; buckets over ``BUCKET_ROWS`` nodes are split the same way on
the bits that are left, so no task depends on one hot value. Within a task, fingerprints are
sorted by Gray rank (neighbours share most bits) and put under a tree: a node keeps the bits
that all its fingerprints share and its parents do not. A search adds up the differences from
the root down and drops a whole group once they exceed the limit; a group whose open bits cannot
exceed it is taken whole. Tasks return a spanning forest of their links, never all pairs.

Cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like
any other; a null id stays and cannot be the name of a group unless all ids of it are null;
repeated rows are one group; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, written
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BUCKET_ROWS = 100_000
FANOUT = 8
QUERY_BLOCK = 4096
_LOWER = bytes(i + 32 if 65 <= i <= 90 else 32 if 9 <= i <= 13 else i for i in range(256))


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)))]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """As an unsigned 64-bit integer."""
    import xxhash
    parts, hash_of = shingles(text, size), xxhash.xxh64_intdigest
    if not parts:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 14):
        h = np.fromiter((hash_of(x, SEED) for x in parts[at:at + (1 << 14)]), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer of the same bits."""
    kind = dict(docs.dtypes)[id_col]

    def rows(part):
        found = np.array([fingerprint(t, size) for t in part.column("text").to_pylist()], np.uint64)
        return [part.column("doc_id"), pa.array(found.view(np.int64))]

    return map_slices(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rows, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Tree over fingerprints sorted by bucket, then in Gray order. Level 0 has the fingerprints;
    a node of level ``k`` stands for up to ``FANOUT`` neighbours of level ``k - 1`` and keeps
    the bits that all of them share and their range of buckets."""

    def __init__(self, values: np.ndarray, buckets: np.ndarray):
        self.order = np.lexsort((gray_rank(values), buckets))
        self.codes, self.buckets = values[self.order], buckets[self.order]
        self.pattern, self.shared = [self.codes], [np.full(len(values), ~np.uint64(0))]
        self.low, self.high = [self.buckets], [self.buckets]
        while len(self.pattern[-1]) > FANOUT:
            below, mask = self.pattern[-1], self.shared[-1]
            starts = np.arange(0, len(below), FANOUT)
            first = np.repeat(below[starts], FANOUT)[:len(below)]
            equal = np.bitwise_and.reduceat(mask & ~(below ^ first), starts)
            self.pattern.append(below[starts] & equal)
            self.shared.append(equal)
            self.low.append(self.low[-1][starts])
            self.high.append(self.high[-1][np.minimum(starts + FANOUT, len(below)) - 1])

    def links(self, limit: int):
        """Pairs of positions, in blocks: enough of the pairs within ``limit`` in a common bucket
        to connect whatever such pairs connect."""
        n, top = len(self.codes), len(self.pattern) - 1
        for at in range(0, n, QUERY_BLOCK):
            query = np.arange(at, min(n, at + QUERY_BLOCK))
            q = np.repeat(query, len(self.pattern[top]))
            node = np.tile(np.arange(len(self.pattern[top])), len(query))
            spent, seen = np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64)
            for level in range(top, -1, -1):
                width = FANOUT ** level
                mine = self.buckets[q]
                keep = (np.minimum((node + 1) * width, n) - 1 > q) & (self.low[level][node] <= mine) & (mine <= self.high[level][node])
                q, node, spent, seen = q[keep], node[keep], spent[keep], seen[keep]
                mask = self.shared[level][node]
                spent = spent + np.bitwise_count((self.codes[q] ^ self.pattern[level][node]) & mask & ~seen)
                if level == 0:
                    close = spent <= limit
                    yield q[close], node[close]
                    break
                open_bits = 64 - np.bitwise_count(mask)
                whole = (spent + open_bits <= limit) & (node * width > q) & (self.low[level][node] == self.high[level][node])
                # all of such a group is within the limit of q and of each other
                yield q[whole], node[whole] * width
                for g in np.unique(node[whole]).tolist():
                    members = np.arange(g * width, min(n, (g + 1) * width))
                    yield members[:-1], members[1:]
                keep = (spent <= limit) & ~whole
                q, spent, seen = (np.repeat(x[keep], FANOUT) for x in (q, spent, mask))
                node = (node[keep][:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = node < len(self.pattern[level - 1])
                q, node, spent, seen = q[there], node[there], spent[there], seen[there]


def forest(values: np.ndarray, buckets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) fingerprints: a spanning star of each group that links within common buckets
    make; groups of one are left out."""
    _, inverse, sizes = np.unique(buckets, return_inverse=True, return_counts=True)
    shared = sizes[inverse] > 1
    values, buckets = values[shared], inverse[shared]
    if not len(values):
        return values, values
    index = GrayIndex(values, buckets)
    nodes, of = np.unique(index.codes, return_inverse=True)
    root = np.arange(len(nodes))
    for a, b in index.links(limit):
        a, b = of[a], of[b]
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while not np.array_equal(root[root], root):
                root = root[root]
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def block_masks(fixed: int, parts: int) -> list[int]:
    """The bits not in ``fixed``, from the highest down, cut into ``parts`` even blocks."""
    free = [i for i in range(63, -1, -1) if not fixed >> i & 1]
    edges = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def bucketed(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS, levels: int = 3) -> DataFrame:
    """(fp, bucket): any two of the distinct fingerprints ``fps(fp)`` within ``max_bits`` share a
    bucket. Buckets over ``bucket_rows`` are split on the bits that they leave open, again while
    some are larger, down to ``levels`` levels; the rest is left to the index."""
    parts, fixed, done = max_bits + 1, [0], []
    rows = fps.select("fp", F.lit(0).alias("path"))
    for level in range(levels):
        masks = [[f | m for m in block_masks(f, parts)] for f in fixed]
        table = F.array(*[F.array(*[_signed(m) for m in row]) for row in masks])
        rows = rows.select("fp", "path", F.posexplode(table[F.col("path")]).alias("block", "mask"))
        rows = rows.select("fp", (F.col("path") * parts + F.col("block")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        rows = rows.withColumn("bucket", F.xxhash64("path", "value"))
        fixed = [m for row in masks for m in row]
        hot = written(rows.groupBy("bucket").count().filter(F.col("count") > bucket_rows), "hot-buckets")
        if level == levels - 1 or hot.isEmpty():
            break
        done.append(rows.join(hot, "bucket", "left_anti").select("fp", "bucket"))
        rows = rows.join(hot, "bucket", "left_semi").select("fp", "path")
    out = rows.select("fp", "bucket")
    for d in done:
        out = out.union(d)
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) between distinct fingerprints: stars that connect exactly what pairs within
    ``max_bits`` connect."""
    def run(batches):
        values, buckets = [], []
        for b in batches:
            values.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            buckets.append(b.column("bucket").to_numpy(zero_copy_only=False))
        if values:
            member, root = forest(np.concatenate(values), np.concatenate(buckets), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(root.view(np.int64)), pa.array(member.view(np.int64))], names=["a", "b"])

    return bucketed(fps, max_bits, bucket_rows).repartition("bucket").mapInArrow(run, "a long, b long")


def dedup_groups(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                 text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``, the smallest id of the
    documents reachable over links, itself included."""
    prints = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = components(links(nodes.select("fp"), max_bits, bucket_rows)).withColumnsRenamed({"node": "fp"})
    nodes = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(nodes.join(named, "root").select("fp", "component_id"), "groups")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
