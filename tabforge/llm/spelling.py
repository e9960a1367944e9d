"""Spelling variants grouped by reduced-alphabet generation.

The letters of a word are hashed to ``SYMBOLS`` symbols; the reduced word's full one-edit
neighbourhood (itself, every deletion, every replacement, every insertion over the few symbols) is
generated and joined with the reduced vocabulary, and what meets is verified on the original words:
two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's
form is its near word of largest count (ties: smallest in code-point order) if that count is
``ratio`` times the word's own; forms are followed to the root.

Many words share a reduced word, so the join key also holds what the edit leaves alone: words are cut
into ``BLOCKS`` blocks, an edit lies in one of them, and the letters of the others must be equal. With
that, words meet that have the same letters outside one block and reduced letters within it that an
edit makes equal, so a group grows with the words that differ in one block only, not with those
that share a reduced word. Counts are combined before each shuffle.

Words come from texts as maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. By the job's rule
a run loses one code point where 199 divides the crc32 of ``<document id>:<run>``.

Cases: a null or empty text has no words; a null id is written as the empty string; repeated rows
count each; words without near words have a null form and are their own root; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
SYMBOLS = 4
BLOCKS = 3
EDIT_EVERY = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of runs once A-Z is lower-cased.
_LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_every: int = EDIT_EVERY,
          least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least ``least_length`` code points and ``least_count`` occurrences."""
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.translate(F.col(text_col), _UPPER, _LOWER).alias("text"))
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))
    rows = d.select("id", run.alias("run")).filter(F.char_length("run") >= least_length)
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(edit_every)) == 0, cut).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def symbol_map(symbols: int = SYMBOLS) -> str:
    """A symbol, as a digit, for each of ``_LETTERS``: an even spread by a multiplicative hash."""
    return "".join(str((ord(c) * 0x9E3779B1 >> 16) % symbols) for c in _LETTERS)


def _edges(length: Column) -> list[Column]:
    """Ends of the blocks of a word of ``length`` code points, from 0 to ``length``."""
    return [F.floor(length * b / BLOCKS).cast("int") for b in range(BLOCKS + 1)]


def _outside(word: Column, start: Column, end: Column) -> Column:
    """What a word keeps without the code points from ``start`` up to ``end``, and where they were."""
    return F.concat_ws("\0", F.substring(word, F.lit(1), start), F.substring(word, end + 1, F.char_length(word)))


def _key(kind: str, block, reduced: Column, kept: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lit(block) if isinstance(block, int) else block, reduced, kept)


def _posts(v: DataFrame) -> DataFrame:
    """(key, near, near_n): where the words wait for edited ones. A word is met by words of its length
    (kind e), by longer ones that lost a symbol (s) and by shorter ones that got one (l)."""
    n, word, red = F.char_length("word"), F.col("word"), F.col("red")
    same, less = _edges(n), _edges(n - 1)
    keys = []
    for b in range(BLOCKS):
        kept = _outside(word, same[b], same[b + 1])
        keys += [_key("e", b, red, kept), _key("s", b, red, kept), _key("l", b, red, _outside(word, less[b], less[b + 1] + 1))]
    return v.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(F.array_distinct(F.array(*keys))).alias("key"))


def _neighbours(v: DataFrame, symbols: int) -> DataFrame:
    """(key, word, n): the full one-edit neighbourhood of each reduced word, by the block of the edit."""
    size = F.char_length("word")
    v = v.withColumn("size", size).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    word, red, b, n = F.col("word"), F.col("red"), F.col("b"), F.col("size")

    def edge(length: Column, k: Column) -> Column:
        return F.floor(length * k / BLOCKS).cast("int")

    v = v.withColumn("lo", edge(n, b)).withColumn("hi", edge(n, b + 1)).withColumn("dlo", edge(n - 1, b)).withColumn("dhi", edge(n - 1, b + 1))
    digits = F.array(*[F.lit(str(s)) for s in range(symbols)])
    lo, hi, dlo, dhi = (F.col(c) for c in ("lo", "hi", "dlo", "dhi"))

    def head(i):
        return F.substring(red, F.lit(1), i)

    def tail(i):
        return F.substring(red, i + 1, n)

    # a word changed within [lo, hi); one that gains a symbol at lo..hi is met by words longer by one; one that
    # loses a symbol at dlo..dhi, by words shorter by one: these see the same edges
    replaced = F.when(hi > lo, F.flatten(F.transform(F.sequence(lo, hi - 1), lambda i: F.transform(digits, lambda c: F.concat(head(i), c, tail(i + 1))))))
    replaced = F.coalesce(replaced, F.array(red))
    inserted = F.flatten(F.transform(F.sequence(lo, hi), lambda i: F.transform(digits, lambda c: F.concat(head(i), c, tail(i)))))
    deleted = F.transform(F.sequence(dlo, dhi), lambda i: F.concat(head(i), tail(i + 1)))
    v = v.select("word", "n", "b", F.array_distinct(replaced).alias("e"), F.array_distinct(inserted).alias("l"), F.array_distinct(deleted).alias("s"),
                 _outside(word, lo, hi).alias("kept"), _outside(word, dlo, dhi + 1).alias("kept_less"))
    keys = [F.transform("e", lambda r: _key("e", F.col("b"), r, F.col("kept"))), F.transform("l", lambda r: _key("l", F.col("b"), r, F.col("kept"))),
            F.transform("s", lambda r: _key("s", F.col("b"), r, F.col("kept_less")))]
    return v.select("word", "n", F.explode(F.concat(*keys)).alias("key"))


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n) of each ordered pair of words that are one edit apart."""
    v = vocabulary.select("word", "n", F.translate("word", _LETTERS, symbol_map(symbols)).alias("red"))
    # a small table, from which much is made: over all tasks
    spread = v.repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    met = _neighbours(spread, symbols).join(_posts(v), "key").filter((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    return met.select("word", "n", "near", "near_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form. Counts grow along a chain by the ratio at each step, so
    it is short; each round doubles the step."""
    step = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = written(moved, "spelling-roots")
        done = moved.filter("moved").isEmpty()
        drop_written(step)
        step = moved.select("word", "root")
        step._written_at = moved._written_at
        if done:
            return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word."""
    vocabulary = written(words(docs, id_col, text_col), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = near_words(vocabulary, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = found.select("word", "n_near", F.col("best.near").alias("top"), (-F.col("best.less")).alias("top_n"))
    all_words = vocabulary.join(found, "word", "left")
    fits = F.col("top_n") >= ratio * F.col("n")
    all_words = written(all_words.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("top")).alias("form"),
                                         F.when(fits, F.col("top_n")).alias("form_n")), "forms")
    roots = _roots(all_words.filter("form is not null"))
    out = all_words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    out = written(out.select("word", "form", "root", "n", "n_near", "form_n"), "variants")
    drop_written(vocabulary, all_words, roots)
    return out

