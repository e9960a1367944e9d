"""Line dedup by an exact set-similarity join, in DataFrame expressions only.

A line's tokens are its distinct shingles of five words (lower case, white space between words
does not count); a line of fewer words has one token, all of it. A line is removed if an earlier
line, in the order of document id and line number, has a Jaccard similarity of 0.8 or more.
Lines without a word are kept.

The join: lines with equal words are one class, named by its first line. Tokens are ordered
by rarity (counts of all tokens in a table of fixed size, so ranks are shared by the tokens of a
cell; any total order gives the same result). With ``n`` tokens, two similar lines share one of
the first ``n - ceil(0.8 n) + 1`` of each (prefix filter); the position of the first shared one
must leave room for enough others (positional filter), and the sizes must be close (length
filter). Each set also has the parity of its tokens in 64 cells: sets that differ in ``d`` tokens
differ in at most ``d`` cells, so pairs with more cells than similar sets may have go without a
look at the texts. Candidates are verified on their whole token sets.

Large groups are never paired with each other: for each token, lines are first compared with the
earliest line that has it, and only lines that this does not remove are compared with the other
earlier lines of the token. What is gathered per token is a count and a smallest row, combined
before the shuffle; joins can be split at hot keys.

Cases: a null text is an empty one and stays null; rows that repeat both id and text are one
document and come back alike; rows that share an id only are ordered by a hash of their texts;
null ids come first; an empty table gives an empty result. Columns other than the id and the
text are carried by ``dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, free_name, written

SHINGLE = 5
NUM, DEN = 4, 5  # least similarity
CELLS = 1 << 14
#: Bits of a token below its rank, in prefixes.
TOKEN_BITS = 48
#: A bit table has 16 bits for each value, and at most so many words of 64.
FILTER_WORDS = 1 << 20
_ID = ["_ld_doc", "_ld_th", "_ld_line"]
_KEY = ["k", "w"]


_BLANKS = "\t\x0b\x0c\r"


def _plain(text: Column) -> Column:
    """``text`` in lower case, its blanks but line ends as spaces; most texts have no others."""
    other = text.contains(_BLANKS[0]) | text.contains(_BLANKS[1]) | text.contains(_BLANKS[2]) | text.contains(_BLANKS[3])
    return F.lower(F.when(other, F.translate(text, _BLANKS, " " * len(_BLANKS))).otherwise(text))


def _shingle(words: Column, i: Column) -> Column:
    """Hash of the shingle that starts at word ``i``: words are looked up one by one, as a slice would copy the line."""
    return F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])


def _tokens(words: Column) -> Column:
    # the line's words are a variable of a lambda function: those of a column would be read from the row for each look-up
    def shingles(line: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(line) - SHINGLE), lambda i: _shingle(line, i))
    parts = F.get(F.transform(F.array(words), shingles), 0)
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(parts)).otherwise(F.array(F.xxhash64(words)))


def _words_of_lines(docs: DataFrame, id_col: str, text_col: str, of=None, only=None) -> DataFrame:
    """A row for each line with a word: where it is and hashes of its words. ``of``: a bit table of
    documents, ``only``: one of places of lines, both asked before words are made."""
    d = docs.select(F.col(id_col).alias("_ld_doc"), F.xxhash64(text_col).alias("_ld_th"), F.coalesce(text_col, F.lit("")).alias("text"))
    if of is not None:
        d = of.keep(d, "_ld_doc", "_ld_th")
    d = d.select("_ld_doc", "_ld_th", F.posexplode(F.split(_plain(F.col("text")), "\n", -1)).alias("_ld_line", "line"))
    if only is not None:
        d = only.keep(d, *_ID)
    words = F.transform(F.array_remove(F.split("line", " ", -1), ""), lambda w: F.xxhash64(w))
    return d.filter(F.ltrim("line") != "").select(*_ID, words.alias("words"))


def _lines(docs: DataFrame, id_col: str, text_col: str, of=None, only=None) -> DataFrame:
    """A row for each line with a word: where it is and its token set ``h``."""
    return _words_of_lines(docs, id_col, text_col, of, only).select(*_ID, _tokens(F.col("words")).alias("h"))


class _Filter:
    """A bit table of hashed values, sized by their number up to a bound and broadcast: rows that it does
    not hold need no join. It only saves work; what passes is joined exactly."""

    def __init__(self, values: DataFrame, *cols: str):
        words = 1 << max(8, min(FILTER_WORDS.bit_length() - 1, (values.count() // 4).bit_length()))
        self.bits = words * 64
        bit = self._bit(cols)
        table = values.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("_ld_i")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("_ld_v"))
        self.table = F.broadcast(written(table, "bits"))  # at most FILTER_WORDS rows of two numbers

    def _bit(self, cols) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.bits))

    def mark(self, df: DataFrame, name: str, *cols: str) -> DataFrame:
        """``df`` with a column: whether the table may hold the row's value."""
        bit = self._bit(cols)
        both = df.join(self.table, F.floor(bit / 64) == F.col("_ld_i"), "left")
        held = F.coalesce(F.getbit("_ld_v", F.pmod(bit, F.lit(64)).cast("int")) == 1, F.lit(False))
        return both.select(*[F.col(c) for c in df.columns], held.alias(name))

    def keep(self, df: DataFrame, *cols: str) -> DataFrame:
        return self.mark(df, "_ld_held", *cols).filter("_ld_held").drop("_ld_held")


def _ranks(stats: DataFrame) -> Column:
    """Rank of each cell by its count, on a fine logarithmic scale and in the bits above those of a token, as a constant array."""
    rank = F.least(F.lit(32767), F.round(F.log2(F.col("c") + 1) * 500)).cast("long")
    found = {r.k: r.r for r in stats.select("k", rank.alias("r")).collect()}
    return F.split(F.lit(",".join(str(found.get(i, 0) << TOKEN_BITS) for i in range(CELLS))), ",").cast("array<bigint>")


def _cell(token: Column) -> Column:
    return token.bitwiseAND(F.lit(CELLS - 1))


def cell_counts(lines: DataFrame) -> DataFrame:
    """(k, c): how many tokens of all lines, given by their ``words``, fall in each cell. Tokens are rows here:
    generated code makes, hashes and counts them without an array of them."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)))
    rows = lines.select("words", F.explode(starts).alias("i"))
    token = F.when(F.size("words") >= SHINGLE, _shingle(F.col("words"), F.col("i"))).otherwise(F.xxhash64("words"))
    return rows.select(_cell(token).alias("k")).groupBy("k").agg(F.count("*").alias("c"))


def _parity(tokens: str) -> Column:
    """In how many tokens, even or odd, each of 64 cells is hit."""
    return F.expr(f"aggregate({tokens}, 0L, (bits, x) -> bits ^ shiftleft(1L, cast(x & 63 as int)))")


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates from rows (token, first, n, pos, bits) of earlier lines ``a`` and later ones ``b``
    after the length, positional and parity filters."""
    x = a.select("token", *[F.col(c).alias(f"a_{c}") for c in ("first", "n", "pos", "bits")])
    y = b.select("token", *[F.col(c).alias(f"b_{c}") for c in ("first", "n", "pos", "bits")])
    both = F.col("a_n") + F.col("b_n")
    room = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    near = (DEN * F.least("a_n", "b_n") >= NUM * F.greatest("a_n", "b_n")) & ((NUM + DEN) * room >= NUM * both)
    # of both sets' tokens at most (DEN - NUM) / (DEN + NUM) are in one set only
    near = near & ((NUM + DEN) * F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= (DEN - NUM) * both)
    return x.join(y, "token").filter((F.col("a_first") < F.col("b_first")) & near).select("a_first", "b_first").distinct()


def _at(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows of ``lines`` at the places ``first``."""
    e = firsts.select(*[F.col(f"first.{c}").alias(f"e_{c}") for c in _ID])
    same = (lines._ld_th == e.e__ld_th) & (lines._ld_line == e.e__ld_line) & lines._ld_doc.eqNullSafe(e.e__ld_doc)
    return lines.join(e, same, "left_semi")


def _held(firsts: DataFrame, *cols: str) -> _Filter:
    return _Filter(firsts.select("first.*"), *cols)


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Places ``first`` of later lines whose similarity to the earlier one is enough."""
    ends = written(pairs.select(F.col("a_first").alias("first")).union(pairs.select("b_first")).distinct(), "line-ends")
    lines = _lines(docs, id_col, text_col, _held(ends, "_ld_doc", "_ld_th"), _held(ends, *_ID))
    sets = _at(lines, ends).select(F.struct(*_ID).alias("first"), "h").dropDuplicates(["first"])
    sets = written(sets, "line-sets")
    drop_written(ends)
    a, b = sets.toDF("a_first", "a_h"), sets.toDF("b_first", "b_h")
    both = pairs.join(a, "a_first").join(b, "b_first")
    common = F.size(F.array_intersect("a_h", "b_h"))
    enough = DEN * common >= NUM * (F.size("a_h") + F.size("b_h") - common)
    return both.filter(enough).select(F.col("b_first").alias("first")).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_ld_doc, _ld_th, lines): numbers of the lines to remove, for documents that have any."""
    ranks = _ranks(cell_counts(_words_of_lines(docs, id_col, text_col)))
    ordered = F.sort_array(F.transform("h", lambda x: F.coalesce(F.get(ranks, _cell(x).cast("int")), F.lit(0)).bitwiseOR(
        x.bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)))))
    size = (F.col("n") - F.floor((NUM * F.col("n") + DEN - 1) / DEN) + 1).cast("int")
    lines = _words_of_lines(docs, id_col, text_col)
    lines = lines.select(*_ID, F.xxhash64("words").alias("k"), F.hash("words").alias("w"), _tokens(F.col("words")).alias("h"))
    lines = lines.select(*_ID, *_KEY, F.size("h").alias("n"), ordered.alias("s"))
    lines = lines.select(*_ID, *_KEY, "n", _parity("s").alias("bits"), F.slice("s", 1, size).alias("prefix"))
    lines = written(lines, "line-prefixes")

    # ``k`` and ``w``, 96 bits of hash of the words, name a class; the 48 bits of a token in ``s`` serve prefixes only.
    # A class is represented by its first line; only classes of several lines need a look-up
    several = written(lines.groupBy(*_KEY).agg(F.count("*").alias("c")).filter("c > 1"), "line-classes")
    one = F.struct(*_ID)
    marked = _Filter(several, *_KEY).mark(lines, "held", *_KEY)
    again = marked.filter("held").select(*_KEY, one.alias("at")).groupBy(*_KEY).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    again = written(again.filter("c > 1").select(*_KEY, "first"), "line-classes")
    drop_written(several)
    maybe = marked.filter("held").drop("held").join(again, _KEY, "left")
    firsts = maybe.filter(F.col("first").isNull() | (F.col("first") == one)).select(one.alias("first"), "n", "bits", "prefix")
    firsts = firsts.union(marked.filter("not held").select(one.alias("first"), "n", "bits", "prefix"))
    posts = firsts.select("first", "n", "bits", F.posexplode("prefix").alias("pos", "token"))

    tokens = written(firsts.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
                     .filter("c > 1").select("token"), "shared-tokens")
    posts = written(_Filter(tokens, "token").keep(posts, "token").join(tokens, "token", "left_semi"), "shared-posts")
    drop_written(tokens)
    heads = written(posts.groupBy("token").agg(F.min(F.struct("first", "n", "pos", "bits")).alias("head"), F.count("*").alias("c")), "heads")
    head = heads.select("token", *[F.col(f"head.{c}").alias(c) for c in ("first", "n", "pos", "bits")])
    gone = written(_verified(written(_pairs(head, posts), "line-pairs"), docs, id_col, text_col), "gone")
    rest = posts.join(gone, "first", "left_anti").join(heads.filter("c > 2").select("token"), "token", "left_semi")
    others = posts.join(heads.filter("c > 2").select("token", F.col("head.first").alias("least")), "token").filter(F.col("first") != F.col("least"))
    more = written(_pairs(others.drop("least"), rest), "line-pairs")
    drop_written(posts, heads)
    gone = gone.union(written(_verified(more, docs, id_col, text_col), "gone")) if not more.isEmpty() else gone

    gone = _at(_held(gone, *_ID).keep(lines, *_ID), gone).select(*_KEY).distinct()
    bad = again.select(*_KEY, "first").join(gone.withColumn("all", F.lit(True)), _KEY, "full")
    bad = written(bad.select(*_KEY, "first", F.coalesce("all", F.lit(False)).alias("all")), "bad-classes")
    out = _Filter(bad, *_KEY).keep(lines, *_KEY).select(*_ID, *_KEY).join(bad, _KEY).filter(F.col("all") | (F.struct(*_ID) != F.col("first")))
    removed = written(out.groupBy("_ld_doc", "_ld_th").agg(F.sort_array(F.collect_set("_ld_line")).alias("_ld_gone")), "removed-lines")
    drop_written(lines, again, bad)
    return removed


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later similar lines taken out of the text, and two more columns, named by ``added_columns``:
    the number of lines with a word before, and the numbers of the lines removed."""
    names, outer = docs.columns, added_columns(docs)
    inner = [f"_c{i}" for i in range(len(names))]  # input columns may have any name
    docs, id_col, text_col = docs.toDF(*inner), inner[names.index(id_col)], inner[names.index(text_col)]
    gone = removed_lines(docs, id_col, text_col)
    d = _Filter(gone, "_ld_doc", "_ld_th").mark(docs.withColumn("_ld_h", F.xxhash64(text_col)), "_ld_hit", id_col, "_ld_h")
    hit = F.col("_ld_hit")
    none = F.array().cast("array<int>")
    g = gone.select(F.col("_ld_doc"), F.col("_ld_th"), "_ld_gone")
    joined = d.filter(hit).join(g, (F.col("_ld_h") == F.col("_ld_th")) & F.col(id_col).eqNullSafe(F.col("_ld_doc")), "left").select(
        *[F.col(c) for c in d.columns], F.coalesce("_ld_gone", none).alias("_ld_gone"))
    joined = joined.withColumn("_ld_split", F.when(F.size("_ld_gone") > 0, F.split(text_col, "\n", -1)))
    lines = F.col("_ld_split")  # a column: it is looked up once for each line
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    shorter = joined.withColumn("_ld_text", F.when(F.size("_ld_gone") > 0, kept).otherwise(F.col(text_col)))
    whole = d.filter(~hit).withColumn("_ld_gone", none).withColumn("_ld_text", F.col(text_col))
    out = shorter.select(*inner, "_ld_gone", "_ld_text").union(whole.select(*inner, "_ld_gone", "_ld_text"))
    blanks = F.lit(" " + _BLANKS)
    with_words = F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), lambda line: F.ltrim(line, blanks) != ""))
    return out.select(*[F.col("_ld_text" if c == text_col else c).alias(n) for c, n in zip(inner, names)], with_words.alias(outer[0]), F.col("_ld_gone").alias(outer[1]))


def added_columns(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns that ``dedup`` adds: ``_ld_lines`` and ``_ld_gone``, or free names like them."""
    return free_name(docs.columns, "_ld_lines"), free_name(docs.columns, "_ld_gone")
