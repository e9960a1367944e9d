"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Base measures of a text (words are runs of characters other than ASCII white space): ``n_words``,
``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``), ``n_dup_lines`` (lines
with a word that equal an earlier line), ``n_repeat_words`` (words in 8-word windows that occur
twice or more, the first included).

A rule rejects a document if its condition holds. On a sample each rule's share of rejections
and its cost (time to evaluate it alone, less the time to read the sample) are measured; rules
are then ordered by rejections per cost and evaluated in a CASE, which stops at the first that
holds. The order changes the work, never the verdict.

Cases: a null or empty text has no words and fails the base; repeated rows are judged each;
columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\x0b\x0c\r "
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SAMPLE_ROWS = 2000
BLOCK_WORDS = 1000


@dataclass(frozen=True)
class Rule:
    """``condition`` is true for documents to reject, false for all others, never null."""
    name: str
    condition: Column


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty), words."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spaced = F.translate("text", WHITE[:-1], " " * (len(WHITE) - 1))
    return out.withColumn("words", F.array_remove(F.split(spaced, " "), ""))


def _repeat_positions(placed: Column) -> Column:
    """Positions of windows that occur more than once: in ``placed``, windows (hash, position)
    sorted by hash, those with an equal neighbour. ``placed`` must be a column, not an expression,
    as it is looked up once for each window."""
    n = F.size(placed)

    def equal_neighbour(x, i):
        return ((i > 0) & (F.get(placed, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(placed, i + 1)["h"] == x["h"]))

    return F.array_sort(F.transform(F.filter(placed, equal_neighbour), lambda x: x["i"]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the base measures."""
    d = with_words(docs, id_col, text_col).withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("windows", F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("repeated", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.col("repeated"), placed))
    d = d.withColumn("at", F.when(F.col("repeated"), _repeat_positions(F.col("placed"))).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda s, i: F.struct(
        (s["n"] + (i + WINDOW - F.greatest(i, s["end"]))).alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, WHITE)) > 0)
    d = d.withColumn("lines", lines)
    return d.select(
        "doc_id", "text", "words", "n_words", F.length(_without(F.col("text"), WHITE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def distinct_in_blocks(words: Column) -> Column:
    """Distinct words of each consecutive block of ``BLOCK_WORDS`` words, added up: as a share of all words it
    does not fall with the length of a text."""
    last = F.floor((F.size(words) - 1) / BLOCK_WORDS).cast("int")
    blocks = F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.size(F.array_distinct(F.slice(words, b * BLOCK_WORDS + 1, BLOCK_WORDS))))


def default_rules() -> list[Rule]:
    """Thresholds far from prose; conditions read the measures and the text."""
    words, n, chars = F.col("words"), F.col("n_words"), F.col("word_chars")
    upper = F.length("text") - F.length(_without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 10 * chars),
        Rule("dup_lines", (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("short_words", chars < 2 * n),
        Rule("long_words", chars > 25 * n),
        Rule("bare_marks", 4 * F.size(F.filter(words, lambda w: ~w.rlike("[\\p{L}\\p{N}]"))) > n),
        Rule("capitals", 2 * upper > chars),
        Rule("shouting", 3 * F.size(F.filter(words, lambda w: w.endswith("!!"))) > n),
        Rule("few_words", 20 * distinct_in_blocks(words) < n),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text",
                sample_rows: int = SAMPLE_ROWS) -> tuple[list[Rule], list[dict]]:
    """Rules by rejections per cost on a random sample of about ``sample_rows`` rows, and what was
    measured. The sample only decides the order."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = measure(docs.sample(share, seed=7) if share < 1 else docs, id_col, text_col).persist(StorageLevel.MEMORY_AND_DISK)

    def seconds(condition: Column) -> tuple[float, int, int]:
        t = time.perf_counter()
        r = sample.agg(F.count("*"), F.count(F.when(condition, 1))).first()
        return time.perf_counter() - t, r[0], r[1]

    seconds(F.lit(False))  # fills the sample
    idle = min(seconds(F.lit(False))[0] for _ in range(2))
    report = []
    for r in rules:
        (t1, n, rejected), (t2, _, _) = seconds(r.condition), seconds(r.condition)
        cost = max(1e-4, min(t1, t2) - idle)
        report.append({"rule": r.name, "cost": cost, "rejected": rejected / max(1, n), "gain": rejected / max(1, n) / cost})
    sample.unpersist()
    gain = {x["rule"]: x["gain"] for x in report}
    return sorted(rules, key=lambda r: -gain[r.name]), report


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.condition, F.lit(r.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, the measures, ``base_failed``, ``rejected_by`` and ``kept``."""
    measured = measure(docs, id_col, text_col)
    ordered, _ = order_rules(docs, rules or default_rules(), id_col, text_col, sample_rows)
    out = measured.withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(first_rejection(ordered)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "rejected_by", F.col("rejected_by").isNull().alias("kept"))
