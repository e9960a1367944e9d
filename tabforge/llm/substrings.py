"""Suffix-array dedup: bytes covered by a ``length``-byte string that also starts earlier are removed.

Texts are UTF-8 bytes; earlier means a smaller document id, or the same document and a smaller
start. Overlaps count, strings are judged on the input, and matches never cross documents.

No suffix array of a whole corpus is built; strings that can be equal are brought together first:

* Each start of a string takes the least hash of the string's ``GRAM``-byte grams, the first one that
  has it. Equal strings take equal values, and neighbouring starts mostly share one gram, so a document
  becomes runs of starts with one gram each, about one run in 30 bytes.
* Values that occur once are left out: their strings have no equal. Runs of one value are gathered,
  with a hash of all their bytes; of equal ones, all but the first are repeats as a whole.
* Where one value has different runs, the bytes of the first of each are fetched and their suffixes are
  sorted by linear grouping construction (``suffixsort``), many groups at once; neighbours in suffix
  order with ``length`` equal bytes are equal strings, and all but the earliest are repeats.

A value with more rows than an eighth of an even partition, of which there are at most eight a
partition, is never gathered in one task: its runs are dealt by their hash too, and of a hash that has as
many rows the first run is found by an aggregation and sent to all tasks, so that its repeats are known where
they are. Groups of over ``LANE_RUNS`` different runs are cut finer: a start then takes the least hashes
of its grams by several hash functions, so runs are shorter and groups hold only strings that agree in nearly
all bytes, and these go the same way. What is still too large is compared string by string with a hash
aggregation.

Cases: a null text is empty; texts under ``length`` bytes are kept; rows that repeat both id and
text are one document and come back alike; rows that share an id only are ordered by a hash of
their texts; null ids come first; an empty table gives an empty result; the id may be of any type
that Spark can order; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, slices, written
from .suffixsort import suffix_order

LENGTH = 100
GRAM = 40
#: Bytes hashed at a time.
BLOCK = 1 << 19
#: Different runs of one value whose suffixes are sorted together; larger groups are cut finer.
LANE_RUNS = 4096
#: A value is hot with more rows than an eighth of an even partition, and than this.
HOT_LEAST = 1000
#: Bytes whose suffixes are sorted at a time.
SORT_BYTES = 1 << 18
#: Values that repeat, sent to tasks as a bit table of 16 bits each, and documents whose ids are broadcast, at most.
FILTER_KEYS = 16_000_000
BROADCAST_DOCS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x


_BYTES = _mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        m = max(n, BLOCK + 2 * LENGTH) + 1
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, x, np.uint64)])) for x in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


class _Hashes:
    """Hashes of any stretch of ``data``, equal for equal bytes wherever they are."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.up[:len(data)])])

    def windows(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[:len(self.sums) - n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    rest = width - done
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def _whole(ends: np.ndarray, at: int, n: int, length: int) -> np.ndarray:
    """Which of the ``n`` starts from ``at`` have ``length`` bytes before the end of their document."""
    begins = np.concatenate([[0], ends[:-1]])
    a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(begins, at + n)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.clip(np.maximum(begins[a:b], ends[a:b] - length + 1) - at, 0, n), 1)
    np.add.at(change, np.clip(ends[a:b] - at, 0, n), -1)
    return np.cumsum(change)[:n] == 0


def runs_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(value, content, start, n): runs of starts with one gram of least hash, in a concatenation of
    documents that end at ``ends``; each start of a whole string is in one run."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at:at + BLOCK + length - 1]
        if len(part) < length:
            continue
        h = _Hashes(part)
        grams = h.windows(gram)
        value = _least(grams, length - gram + 1)
        valid = _whole(ends, at, len(value), length)
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (grams[:len(value) - 1] == value[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(value)))
        keep = valid[first]
        first, n = first[keep], n[keep]
        out.append((value[first], h.of(first, first + n - 1 + length), first + at, n))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))


def _joined(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice after each other, and their ends."""
    texts = [t or b"" for t in part.column("text").to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _values(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h): the value of each run."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                value = runs_of(*_joined(part), length, gram)[0]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def _runs(docs: DataFrame, length: int, gram: int, bits) -> DataFrame:
    """(h, c, doc, th, x, n): runs whose value passes the bit table; ``x`` is the start in the document."""
    kind = dict(docs.dtypes)["doc"]

    def run(batches):
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in slices(batch):
                data, ends = _joined(part)
                value, content, start, n = runs_of(data, ends, length, gram)
                if table is not None:
                    bit = value % np.uint64(8 * len(table))
                    held = np.flatnonzero(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    value, content, start, n = value[held], content[held], start[held], n[held]
                of = np.searchsorted(ends, start, side="right")
                x = start - np.concatenate([[0], ends])[of]
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(content.view(np.int64)), part.column("doc").take(rows),
                                                  part.column("th").take(rows), pa.array(x.astype(np.int32)), pa.array(n.astype(np.int16))],
                                                 names=["h", "c", "doc", "th", "x", "n"])

    return docs.mapInArrow(run, f"h long, c long, doc {kind}, th long, x int, n short")


def _bit_table(keys: DataFrame, count: int):
    """A broadcast bit table of the values ``keys(h)``, or None if there are too many for one."""
    if count > FILTER_KEYS:
        return None
    size = 1 << max(10, (16 * count).bit_length())
    bits = keys.select(F.expr(f"cast(h & {size - 1} as int)").alias("b")).toArrow().column("b").to_numpy()
    table = np.zeros(size, np.uint8)
    table[bits] = 1
    return keys.sparkSession.sparkContext.broadcast(np.packbits(table, bitorder="little").tobytes())


def _by_groups(batches, key: str, least: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups of rows of one ``key``, from batches sorted by it."""
    waiting, rows = [], 0
    for b in batches:
        waiting.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(waiting).combine_chunks()
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield t.slice(0, cut)
        waiting, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, null too."""
    return pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


#: What becomes of a run: all of it repeats; its suffixes are to be sorted with those of its group; its group was
#: dealt over tasks or is too large.
REPEAT, SORT, LARGE = 0, 1, 2
#: Grams and hash functions of the finer cut.
FINE_GRAM, FINE_MIXES = 24, (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _sorted_out(runs: DataFrame, partitions: int, kind: str, lane_runs: int) -> DataFrame:
    """(kind, h, doc, th, x, n) of ``runs`` with a column ``hot``: true where the runs of the value are dealt
    over several tasks."""
    def run(batches):
        for t in _by_groups(batches, "h"):
            h, c, th, x = (t.column(k).to_numpy() for k in ("h", "c", "th", "x"))
            doc, hot = _codes(t.column("doc")), t.column("hot").to_numpy()
            keep = np.flatnonzero(_changes(h, c, doc, th, x))
            h, c, hot = h[keep], c[keep], hot[keep]
            new = _changes(h, c)
            group = np.cumsum(_changes(h)) - 1
            different = np.bincount(group, weights=new)[group]
            what = np.where(~new, REPEAT, np.where(hot | (different > lane_runs), LARGE, SORT))
            out = ~new | hot | (different > 1)
            rows = t.take(pa.array(keep[out])).drop_columns(["c", "hot"])
            yield from rows.add_column(0, "kind", pa.array(what[out].astype(np.int16))).to_batches()

    ordered = runs.repartition(partitions, "h", F.when(F.col("hot"), F.col("c"))).sortWithinPartitions("h", "c", "doc", "th", "x")
    return ordered.mapInArrow(run, f"kind short, h long, doc {kind}, th long, x int, n short")


def _with_zero(table: DataFrame) -> DataFrame:
    """``table`` and a row with ``h`` zero and nothing else, so that plans are the same where there is nothing to look up."""
    zero = [F.lit(0 if f.name in ("h", "c") else None).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    return table.unionByName(table.sparkSession.range(1).select(*zero))


def _kinds(runs: DataFrame, keys: DataFrame, limit: int, partitions: int, kind: str, lane_runs: int) -> DataFrame:
    """What becomes of each run; values and hashes with over ``limit`` rows, few by its choice, are broadcast."""
    place = F.struct("doc", "th", "x")
    hot = written(_with_zero(keys.filter(F.col("n") > limit).select("h", F.lit(True).alias("hot"))).coalesce(1), "hot-values")
    dealt = runs.join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # runs of other values are one group of NULLs, combined before the shuffle
    own = [F.when(F.col("hot"), F.col(c)).alias(c) for c in ("h", "c")]
    classes = dealt.groupBy(*own).agg(F.count("*").alias("rows"), F.min(place).alias("first")).filter((F.col("rows") > limit) & F.col("h").isNotNull())
    classes = written(_with_zero(classes.select("h", "c", "first")).coalesce(1), "hot-runs")
    later = F.col("first").isNotNull() & (place != F.col("first"))
    marked = dealt.join(F.broadcast(classes), ["h", "c"], "left").select("h", "c", "doc", "th", "x", "n", "hot", later.alias("later"))
    marked = written(marked, "marked-runs")
    drop_written(runs)
    repeats = marked.filter("later").select(F.lit(REPEAT).cast("short").alias("kind"), "h", "doc", "th", "x", "n")
    out = written(_sorted_out(marked.filter("not later").drop("later"), partitions, kind, lane_runs).unionByName(repeats), "run-kinds")
    drop_written(hot, classes, marked)
    return out


def _settled(out: DataFrame, lane_runs: int) -> tuple[DataFrame, DataFrame]:
    """The runs of ``_kinds`` to be sorted, and those of groups that are too large for it."""
    large = out.filter(F.col("kind") == LARGE)
    sizes = written(_with_zero(large.groupBy("h").agg(F.count("*").alias("different"))), "group-sizes")
    open_runs = out.filter(F.col("kind") != REPEAT).join(sizes, "h", "left")
    few = (F.col("kind") == SORT) | F.col("different").between(2, lane_runs)
    return open_runs.filter(few).drop("different"), open_runs.filter(F.col("different") > lane_runs).drop("different")


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, th, text, runs): the documents that have runs ``wanted``, with them."""
    lists = wanted.groupBy(F.col("doc").alias("run_doc"), F.col("th").alias("run_th")).agg(F.collect_list(F.struct("h", "x", "n")).alias("runs"))
    lists = written(lists, "wanted-runs")
    if lists.count() <= BROADCAST_DOCS:
        docs = docs.join(F.broadcast(lists.select(F.col("run_th").alias("th")).distinct()), "th", "left_semi")
    return docs.join(lists, F.col("doc").eqNullSafe(F.col("run_doc")) & (F.col("th") == F.col("run_th"))).select("doc", "th", "text", "runs")


def _each_run(batches, length: int):
    """For slices of ``_fetched`` rows: the slice, and the row, value, start and bytes of each run."""
    for batch in batches:
        for part in slices(batch, 64):
            texts, lists = part.column("text").to_pylist(), part.column("runs")
            runs = lists.flatten()
            h, x, n = (runs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "x", "n"))
            rows = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            data = [texts[i][a:b] for i, a, b in zip(rows.tolist(), x.tolist(), (x + n - 1 + length).tolist())]
            yield part, rows, h, x, data


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, doc, th, x, bytes) of the runs ``wanted``."""
    def run(batches):
        for part, rows, h, x, data in _each_run(batches, length):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(h), part.column("doc").take(at), part.column("th").take(at),
                                              pa.array(x.astype(np.int32)), pa.array(data, pa.binary())], names=["h", "doc", "th", "x", "bytes"])

    return _fetched(docs, wanted).mapInArrow(run, f"h long, doc {dict(docs.dtypes)['doc']}, th long, x int, bytes binary")


def _finer(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, c, doc, th, x, n): the runs ``wanted`` cut wherever the least gram by any of several hash functions
    changes; ``h`` names the value of the run and those grams."""
    gram = min(FINE_GRAM, length)

    def run(batches):
        for part, rows, values, x, data in _each_run(batches, length):
            joined, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(b) for b in data])
            hashes = _Hashes(joined)
            whole = _whole(ends, 0, max(0, len(joined) - length + 1), length)
            grams = hashes.windows(gram)
            new = np.append(True, whole[1:] != whole[:-1])
            key = np.repeat(values.view(np.uint64), np.diff(ends, prepend=0))[:len(whole)]
            for mix in FINE_MIXES:
                g = grams * np.uint64(mix)
                least = _least(g ^ (g >> np.uint64(29)), length - gram + 1)
                new[1:] |= (least[1:] != least[:-1]) | ((g ^ (g >> np.uint64(29)))[:len(whole) - 1] == least[:-1])
                key = _mix(key ^ least)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(whole)))
            first, n = first[whole[first]], n[whole[first]]
            of = np.searchsorted(ends, first, side="right")
            at = pa.array(rows[of])
            place = x[of] + first - np.concatenate([[0], ends[:-1]])[of]
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(hashes.of(first, first + n - 1 + length).view(np.int64)),
                                              part.column("doc").take(at), part.column("th").take(at), pa.array(place.astype(np.int32)),
                                              pa.array(n.astype(np.int16))], names=["h", "c", "doc", "th", "x", "n"])

    return _fetched(docs, wanted).mapInArrow(run, f"h long, c long, doc {dict(docs.dtypes)['doc']}, th long, x int, n short")


def _strings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(s1, s2, doc, th, x): 128 bits of hash of each string of the runs ``wanted``, and where it starts."""
    def run(batches):
        for part, rows, _, x, data in _each_run(batches, length):
            joined, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(b) for b in data])
            one, two = _Hashes(joined).windows(length), _Hashes(joined ^ np.uint8(0x5A)).windows(length)
            s = np.flatnonzero(_whole(ends, 0, len(one), length))
            of = np.searchsorted(ends, s, side="right")
            at = pa.array(rows[of])
            place = x[of] + s - np.concatenate([[0], ends[:-1]])[of]
            yield pa.RecordBatch.from_arrays([pa.array(one[s].view(np.int64)), pa.array(two[s].view(np.int64)), part.column("doc").take(at),
                                              part.column("th").take(at), pa.array(place.astype(np.int32))], names=["s1", "s2", "doc", "th", "x"])

    return _fetched(docs, wanted).mapInArrow(run, f"s1 long, s2 long, doc {dict(docs.dtypes)['doc']}, th long, x int")


def _aggregated(strings: DataFrame, length: int) -> DataFrame:
    """(doc, th, a, b): the strings that are not the first of their kind."""
    strings = written(strings, "strings")
    place = F.struct("doc", "th", "x")
    first = strings.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last"))
    later = strings.join(first.select("s1", "s2", "first"), ["s1", "s2"]).filter(place != F.col("first"))
    return later.select("doc", "th", F.col("x").alias("a"), (F.col("x") + length).alias("b"))


def repeated_starts(groups: list[list[tuple[int, int, bytes]]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """For each (document, start, bytes) of each group: the starts, in the document, of its strings
    that occur earlier in the group. Documents are numbered in their order."""
    parts, lengths, doc, x, ends = [], [], [], [], []
    at = 0
    for g in groups:
        size = 1
        for d, start, b in g:
            parts += [b, b"\n"]
            doc.append(d)
            x.append(start)
            ends.append(at + size - 1 + len(b))
            size += len(b) + 1
        parts.append(b"\n")
        lengths.append(size)
        at += size
    data = np.frombuffer(b"".join(parts), np.uint8)
    symbols = data.astype(np.int64) + 2
    ends = np.array(ends)
    symbols[ends] = 1
    symbols[np.cumsum(lengths) - 1] = 0
    order = suffix_order(symbols, np.array(lengths))
    begin = np.concatenate([[0], ends[:-1] + 1])
    begin[np.cumsum([len(g) for g in groups])[:-1]] += 1  # behind the last symbol of the lane before
    run = np.minimum(np.searchsorted(ends, order), len(ends) - 1)
    whole = (begin[run] <= order) & (order + length <= ends[run])
    order, run = order[whole], run[whole]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[run]
    place = (np.array(doc)[run] << 32) + np.array(x)[run] + order - begin[run]
    equal = np.zeros(len(order), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        equal[a:b] = (group[a:b] == group[a - 1:b - 1]) & (windows[order[a:b]] == windows[order[a - 1:b - 1]]).all(axis=1)
    first = np.flatnonzero(~equal)
    later = place > np.repeat(np.minimum.reduceat(place, first) if len(first) else place, np.diff(np.append(first, len(order))))
    by = np.lexsort((order[later], run[later]))
    run, found = run[later][by], (place[later] & 0xFFFFFFFF)[by]
    cuts = np.searchsorted(run, np.arange(len(ends) + 1))
    each = iter([found[a:b] for a, b in zip(cuts, cuts[1:])])
    return [[next(each) for _ in g] for g in groups]


def shared_part(data: list[bytes], group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of bytes the range that holds its strings whose hash its group has twice: other
    suffixes have no equal and need not be sorted. Equal ends: none."""
    low, high = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    joined, sizes = np.frombuffer(b"".join(data), np.uint8), np.array([len(b) for b in data], np.int64)
    if len(joined) < length:
        return low, high
    ends = np.cumsum(sizes)
    value = _Hashes(joined).windows(length)
    starts = np.flatnonzero(_whole(ends, 0, len(value), length))
    of = np.repeat(np.arange(len(data)), sizes)[starts]
    key = value[starts] ^ _mix(group[of].astype(np.uint64) + np.uint64(1))
    by = np.argsort(key)
    equal = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(key), bool)
    twice[by[1:][equal]] = True
    twice[by[:-1][equal]] = True
    starts, of = starts[twice], of[twice]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    which = of[first]
    low[which] = starts[first] - (ends - sizes)[which]
    high[which] = starts[np.append(first[1:], len(starts)) - 1] - (ends - sizes)[which] + length if len(first) else 0
    return low, high


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending starts as stretches (start, end) of the bytes that their strings cover."""
    first = np.flatnonzero(np.diff(starts, prepend=-length - 2) > length)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + length if len(starts) else starts


def _suffix_sorted(contexts: DataFrame, partitions: int, length: int, kind: str) -> DataFrame:
    """(doc, th, a, b): stretches of repeats within the runs of each value."""
    def run(batches):
        def solved(t, groups):
            lanes = [[(d, s, b) for _, d, s, b in g] for g in groups]
            rows, a, b = [], [], []
            for g, starts in zip(groups, repeated_starts(lanes, length)):
                for (i, *_), s in zip(g, starts):
                    if len(s):
                        lo, hi = _spans(s, length)
                        rows += [i] * len(lo)
                        a += lo.tolist()
                        b += hi.tolist()
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([t.column("doc").combine_chunks().take(at), t.column("th").combine_chunks().take(at), pa.array(a, pa.int32()),
                                               pa.array(b, pa.int32())], names=["doc", "th", "a", "b"])

        for t in _by_groups(batches, "h", 1 << 14):
            h, th, x = (t.column(k).to_numpy() for k in ("h", "th", "x"))
            document = np.cumsum(_changes(h, _codes(t.column("doc")), th))
            data = t.column("bytes").to_pylist()
            low, high = shared_part(data, np.cumsum(_changes(h)) - 1, length)
            groups, size, now = [], 0, None
            for i in np.flatnonzero(high > low).tolist():
                if h[i] != now and size >= SORT_BYTES:
                    yield solved(t, groups)
                    groups, size = [], 0
                if h[i] != now or not groups:
                    groups.append([])
                now = h[i]
                groups[-1].append((i, int(document[i]), int(x[i] + low[i]), data[i][low[i]:high[i]]))
                size += int(high[i] - low[i]) + 1
            if groups:
                yield solved(t, groups)

    ordered = contexts.repartition(partitions, "h").sortWithinPartitions("h", "doc", "th", "x")
    return ordered.mapInArrow(run, f"doc {kind}, th long, a int, b int")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, lane_runs: int = LANE_RUNS, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc, th, a, b): stretches of bytes, which may overlap, that strings which also start earlier
    cover in documents ``docs(doc, th, text)``."""
    kind = dict(docs.dtypes)["doc"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = _values(docs, length, gram).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    keys = written(counts, "repeated-values")
    n_keys, n_rows = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = _bit_table(keys, n_keys)
    runs = _runs(docs, length, gram, bits)
    if bits is None:
        runs = runs.join(keys.select("h"), "h")
    runs = written(runs, "runs")
    def solved(runs, keys, rows):
        # at most eight values a partition hold more than an eighth of an even one
        out = _kinds(runs, keys, max(hot_least, rows // (8 * partitions)), partitions, kind, lane_runs)
        drop_written(keys)
        sort, many = _settled(out, lane_runs)
        whole = out.filter(F.col("kind") == REPEAT).select("doc", "th", F.col("x").alias("a"), (F.col("x") + F.col("n") - 1 + length).alias("b"))
        return [whole, _suffix_sorted(_contexts(docs, sort, length), partitions, length, kind)], many

    spans, many = solved(runs, keys, n_rows)
    if not many.isEmpty():
        finer = written(_finer(docs, many, length), "finer-runs")
        counts = written(finer.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "finer-values")
        more, many = solved(finer, counts, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        spans += more
        if not many.isEmpty():
            spans.append(_aggregated(_strings(docs, many, length), length))
    result = spans[0]
    for s in spans[1:]:
        result = result.union(s)
    return result


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the bytes of its text, the maximal stretches removed,
    as (start, end), and the bytes that stay, after each other."""
    d = _texts(docs, id_col, text_col)
    kind = dict(d.dtypes)["doc"]
    spans = repeats(d, length, gram).groupBy(F.col("doc").alias("span_doc"), F.col("th").alias("span_th")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    both = d.join(spans, F.col("doc").eqNullSafe(F.col("span_doc")) & (F.col("th") == F.col("span_th")), "left").select("doc", "text", "spans")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, lists = [t or b"" for t in part.column("text").to_pylist()], part.column("spans")
                row, a, b = _merged(lists)
                cuts = np.searchsorted(row, np.arange(len(texts) + 1))
                kept = []
                for i, text in enumerate(texts):
                    mine = slice(cuts[i], cuts[i + 1])
                    if cuts[i] == cuts[i + 1]:
                        kept.append(text)
                    else:
                        starts, ends = [0, *b[mine].tolist()], [*a[mine].tolist(), len(text)]
                        kept.append(b"".join(text[s:e] for s, e in zip(starts, ends)))
                spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["start", "end"])
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([len(t) for t in texts], pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans).cast(span), pa.array(kept, pa.binary())],
                                                 names=["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")


def _merged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): the maximal stretches of each row's list of stretches, in order."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    spans = lists.flatten()
    a, b = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "b"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((a, row))
    row, a, b = row[by], a[by], b[by]
    reach = np.maximum.accumulate((row << 32) + b) if len(row) else row
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] << 32) + a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], a[first], (reach[last] & 0xFFFFFFFF) if len(row) else a
