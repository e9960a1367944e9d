"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Texts are cut into pieces at ``[.,;:!?]`` and line ends, pieces into words at spaces and tabs; only
A-Z is lower-cased. For each language: the words that occur ``least`` times get numbers, every
position becomes the row of the numbers of its next ``depth`` words (up to the end of its piece or a
rarer word), and rows are routed over the cluster by their leading words. A task sorts pointers to
its rows by multikey three-way quicksort: a partition equal to the pivot at depth ``d`` is one phrase
of ``d + 1`` words and its size is the count; partitions below ``least`` are abandoned, as no phrase
in them can reach it. Scores, the test for containment and the ranks are joins and aggregations.

Routing: by the first two words. A prefix that would hold over a quarter of an even partition, by a
sample, is routed by one more word, and so on; such prefixes, at most four a partition, are shared
by all tasks, their counts are summed over tasks, and equal whole rows of them are added up before
they leave a task. The word numbers are broadcast if at most ``BROADCAST_WORDS`` words qualify;
beyond that, words are named by 64-bit hashes and none is left out before the sort.

Cases: a null or empty text has no words; a null language is ``und``; repeated rows count each; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, slices, written

LEAST = 100
DEPTH = 5
TOP = 2000
#: Words sent to every task at most; beyond, words are named by hashes.
BROADCAST_WORDS = 1_000_000
#: One of so many documents is read to find prefixes that hold many rows.
SAMPLE = 32
#: Words counted, or positions gathered, before a task hands them on.
FLUSH = 1 << 20
_END = b"\xff"  # in no UTF-8 text
_PLAIN = bytes(32 if i == 9 else 255 if i in b".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in order, with ``_END`` between pieces."""
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).replace(_END, b" \xff ").split()


def _inputs(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, f): occurrences of each word; the row whose word is null has those of all."""
    def run(batches):
        counts: dict[str, Counter] = {}
        held = 0

        def out():
            rows = [(lang, w, k) for lang, c in counts.items() for w, k in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
                                               pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "f"])

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    c = counts.setdefault(lang, Counter())
                    found = words_of(text)
                    before = len(c)
                    c.update(found)
                    c[None] += len(found) - c.pop(_END, 0)
                    held += len(c) - before
                if held > FLUSH // 4:
                    yield out()
                    held = 0
        if counts:
            yield out()

    rows = _inputs(docs, text_col, lang_col).mapInArrow(run, "lang string, word binary, f long")
    return rows.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("f").alias("f"))


class _Numbers:
    """Word -> number above 0, for each language; 0: not to be followed."""

    def __init__(self, table: list | None):
        self.by: dict[str, dict[bytes, int]] = {}
        for lang, word, number in table or []:
            self.by.setdefault(lang, {})[word.encode()] = number
        self.exact = table is not None

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        if self.exact:
            get = self.by.get(lang, {}).get
            return np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        return np.fromiter((0 if w == _END else word_hash(lang, w) for w in words), np.int64, len(words))


def word_hash(lang: str, word: bytes) -> int:
    """A positive 63-bit name of a word of a language."""
    import xxhash
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "replace") + _END + word) >> 1 or 1


def suffix_rows(numbers: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each position with two words or more to follow, the numbers of its next ``depth`` words; 0
    from where the run of followed words ends."""
    padded = np.concatenate([numbers, np.zeros(depth, np.int64)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[:len(numbers)]
    rows = rows[(rows[:, 0] > 0) & (rows[:, 1] > 0)].copy()
    for d in range(2, depth):
        rows[:, d] *= rows[:, d - 1] > 0
    return rows


def _mixed(rows: np.ndarray, n: int) -> np.ndarray:
    """A hash of the first ``n`` numbers of each row."""
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for d in range(n):
        h = (h ^ rows[:, d].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _numbered(docs: DataFrame, numbers, depth: int, emit, schema: str) -> DataFrame:
    """``emit(rows)`` record batches of suffix rows, gathered over documents up to ``FLUSH``. ``numbers``: broadcast table, or None."""
    def run(batches):
        code = numbers_of(numbers)
        waiting, held = [], 0
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    rows = suffix_rows(code.of(lang, words_of(text)), depth)
                    waiting.append(rows)
                    held += len(rows)
                    if held >= FLUSH:
                        yield from emit(np.concatenate(waiting))
                        waiting, held = [], 0
        if held:
            yield from emit(np.concatenate(waiting))

    return docs.mapInArrow(run, schema)


_CODES: list = []


def numbers_of(table) -> _Numbers:
    """The numbers of this worker, built once for a broadcast table."""
    if not _CODES or _CODES[0] is not table:
        _CODES[:] = [table, _Numbers(None if table is None else table.value)]
    return _CODES[1]


def _hot_prefixes(docs: DataFrame, numbers, depth: int, partitions: int, sample: int) -> list[np.ndarray]:
    """By length from 2 to ``depth - 1``: sorted hashes of the prefixes that hold over a quarter of an
    even partition of a sample of documents. At most four times ``partitions`` of each length."""
    def emit(rows):
        for n in range(2, depth):
            have = rows[rows[:, n - 1] > 0] if n > 2 else rows
            h, c = np.unique(_mixed(have, n), return_counts=True)
            big = c > len(rows) / (8 * partitions)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(big.sum() + 1, n), pa.int32()), pa.array(np.append(h[big], np.uint64(0)).view(np.int64)),
                                              pa.array(np.append(c[big], len(rows)))], names=["n", "h", "c"])

    some = docs if sample <= 1 else docs.filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    counts = _numbered(some, numbers, depth, emit, "n int, h long, c long").groupBy("n", "h").agg(F.sum("c").alias("c"))
    total = F.max(F.when(F.col("h") == 0, F.col("c"))).over(Window.partitionBy("n"))
    hot = counts.withColumn("total", total).filter((F.col("h") != 0) & (F.col("c") * 4 * partitions > F.col("total"))).select("n", "h").collect()
    return [np.sort(np.array([r.h for r in hot if r.n == n], np.int64).view(np.uint64)) for n in range(2, depth)]


def route(rows: np.ndarray, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(levels, hashes): by how many leading words each row is routed, and their hash."""
    level, depth = np.full(len(rows), 2), rows.shape[1]
    hashes = _mixed(rows, 2)
    for n in range(2, depth):
        if len(hot[n - 2]):
            mine = np.flatnonzero((level == n) & np.isin(hashes, hot[n - 2]))
            level[mine] = n + 1
            hashes[mine] = _mixed(rows[mine], n + 1)
    return level, hashes


def multikey_counts(rows: np.ndarray, weights: np.ndarray, least: int, first: int = 2, last: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """(phrase, count) of every prefix of ``first`` to ``last`` words whose weight is ``least`` or more.

    Multikey three-way quicksort of pointers to ``rows``: a range of pointers is parted around a pivot
    number at its depth; the equal part goes on one word deeper, and its weight is the phrase's count.
    Ranges under ``least`` are abandoned."""
    depth = last or rows.shape[1]
    todo = [(np.arange(len(rows)), 0)]
    while todo:
        at, d = todo.pop()
        keys = rows[at, d]
        live = keys > 0
        if not live.all():
            at, keys = at[live], keys[live]
        if not len(at) or int(weights[at].sum()) < least:
            continue
        pivot = np.partition(keys, len(keys) // 2)[len(keys) // 2]
        equal = at[keys == pivot]
        n = int(weights[equal].sum())
        if n >= least:
            if d + 1 >= first:
                yield rows[equal[0], :d + 1], n
            if d + 1 < depth:
                todo.append((equal, d + 1))
        if len(equal) < len(at):
            todo.append((at[keys < pivot], d))
            todo.append((at[keys > pivot], d))


def phrase_counts(docs: DataFrame, numbers, least: int = LEAST, depth: int = DEPTH, sample: int = SAMPLE) -> DataFrame:
    """(p, f): numbers of the words of each phrase of 2 to ``depth`` words, and its count, if that is ``least`` or more."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_prefixes(docs, numbers, depth, partitions, sample)
    buckets, kind = 4 * partitions, "<i4" if numbers is not None else "<i8"

    def emit(rows):
        level, hashes = route(rows, hot)
        weights = np.ones(len(rows), np.int64)
        if (level == depth).any():  # a whole row that is one of very many
            whole, n = np.unique(rows[level == depth], axis=0, return_counts=True)
            rest = level != depth
            rows, weights = np.concatenate([rows[rest], whole]), np.concatenate([weights[rest], n])
            level, hashes = np.concatenate([level[rest], np.full(len(whole), depth)]), np.concatenate([hashes[rest], _mixed(whole, depth)])
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        key = bucket * (depth + 1) + level
        order = np.argsort(key, kind="stable")
        key, rows, weights = key[order], rows[order].astype(kind), weights[order].astype("<i8")
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(starts[1:], len(key))
        blocks = [rows[a:b].tobytes() for a, b in zip(starts, ends)]
        # weights other than one are of whole rows only
        w = [weights[a:b].tobytes() if k % (depth + 1) == depth else b"" for a, b, k in zip(starts, ends, key[starts])]
        yield pa.RecordBatch.from_arrays([pa.array(key[starts] // (depth + 1), pa.int64()), pa.array(key[starts] % (depth + 1), pa.int32()),
                                          pa.array(blocks, pa.binary()), pa.array(w, pa.binary())], names=["bucket", "level", "rows", "weights"])

    def count(batches):
        def bucket_of(blocks):
            found = []
            for n in sorted({b[0] for b in blocks}):
                rows = np.concatenate([np.frombuffer(r, kind).reshape(-1, depth) for k, r, _ in blocks if k == n]).astype(np.int64)
                weights = np.concatenate([np.frombuffer(w, "<i8") for k, _, w in blocks if k == n]) if n == depth else np.ones(len(rows), np.int64)
                found.extend(multikey_counts(rows, weights, least, first=n))
                if n > 2:  # shorter prefixes are spread over tasks: counts of all of them, to be summed
                    found.extend(multikey_counts(rows, weights, 1, last=n - 1))
            return pa.RecordBatch.from_arrays([pa.array([p.tolist() for p, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.int64())], names=["p", "c"])

        now, blocks = None, []
        for batch in batches:
            for bucket, level, rows, weights in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now and blocks:
                    yield bucket_of(blocks)
                    blocks = []
                now = bucket
                blocks.append((level, rows, weights))
        if blocks:
            yield bucket_of(blocks)

    routed = _numbered(docs, numbers, depth, emit, "bucket long, level int, rows binary, weights binary")
    parts = routed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "p array<bigint>, c long")
    return parts.groupBy("p").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)


def _numbered_words(words: DataFrame, limit: int):
    """(table (lang, word, number), broadcast rows or None) of the words that qualify."""
    if words.count() <= limit:
        # at most ``limit`` rows: one task numbers them
        table = written(words.select("lang", "word").coalesce(1).withColumn("number", F.monotonically_increasing_id() + 1), "numbers")
        return table, words.sparkSession.sparkContext.broadcast([tuple(r) for r in table.collect()])

    def run(batches):
        for b in batches:
            named = [word_hash(lang, w.encode()) for lang, w in zip(b.column("lang").to_pylist(), b.column("word").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("word"), pa.array(named, pa.int64())], names=["lang", "word", "number"])

    return words.select("lang", "word").mapInArrow(run, "lang string, word string, number long"), None


def score_of(a: str, n: str, left: str, right: str) -> Column:
    """``floor(1000 a n / (l r))`` in exact decimals of 38 digits."""
    num, den = (f"cast(cast({x} as decimal(19,0)) * cast({y} as decimal(19,0)) as decimal(38,0))" for x, y in ((a, n), (left, right)))
    return F.expr(f"cast({num} * cast(1000 as decimal(4,0)) as decimal(38,0)) div {den}")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, depth: int = DEPTH, top: int = TOP,
                 broadcast_words: int = BROADCAST_WORDS, sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language. ``score`` is the
    least over all cuts of ``floor(1000 a n / (l r))``; phrases that a longer one contains as often as
    they occur are left out."""
    d = _inputs(docs, text_col, lang_col)
    every = written(word_counts(d).filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = every.filter("word is null").select("lang", F.col("f").alias("n"))
    words = every.filter("word is not null")
    table, numbers = _numbered_words(words, broadcast_words)
    counts = written(phrase_counts(d, numbers, least, depth, sample), "phrases")
    if numbers is not None:
        numbers.unpersist()
    # numbers back to words; a number belongs to one language
    spelt = counts.select("p", "f", F.posexplode("p").alias("i", "number")).join(table, "number")
    spelt = spelt.groupBy("p").agg(F.first("f").alias("f"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    phrases = written(spelt.select("lang", F.col("w.word").alias("w"), "f"), "spelt")
    single = words.select("lang", F.array("word").alias("w"), "f")
    known = written(single.union(phrases), "known")

    cuts = phrases.withColumnRenamed("f", "a").select("lang", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("left"), F.slice("w", F.col("k") + 1, F.size("w")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("w").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("w").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals) if _few(totals) else totals, "lang")
    cuts = cuts.withColumn("score", score_of("a", "n", "l", "r"))
    best = cuts.groupBy("lang", "w", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    longer = phrases.filter(F.size("w") > 2).select("lang", "w", "f", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    longer = longer.select("lang", "w", "f", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inside = longer.select("lang", F.slice("w", F.col("i"), F.col("m")).alias("w"), "f").groupBy("lang", "w").agg(F.max("f").alias("most"))
    left = best.join(inside, ["lang", "w"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("a")))
    out = left.select("lang", F.array_join("w", " ").alias("phrase"), "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
    result = written(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop_written(every, counts, phrases, known)
    return result


def _few(totals: DataFrame, limit: int = 10_000) -> bool:
    return totals.limit(limit + 1).count() <= limit
