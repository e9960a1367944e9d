"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of a
benchmark, every document text scanned once, hits mapped to offsets in the original text.

Normalising lower-cases A-Z and keeps words of digits, letters and all non-ASCII characters. A
window is ``window`` consecutive words of an item; an item with fewer words, but not none, is
one window. A document word inside any occurrence of a window is hit.

Cases: a null text has no words and is clean; a null item id counts as the id ''; repeated items
and windows count once per id; an empty benchmark hits nothing; columns of ``docs`` other than
the id and the text are not read, so their names cannot clash.

The documents are never shuffled: the patterns go to the tasks. Their size is checked: they are
cut by a hash into blocks of about ``block_chars`` characters and each block is a scan of its
own over the result of the one before, so no task or driver ever holds more than one block.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, slices

WINDOW = 10
BLOCK_CHARS = 16_000_000
#: Bytes to normalised bytes: A-Z to a-z, digits, a-z and bytes of non-ASCII characters stay, others become a space.
_NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BUILT: dict[str, object] = {}
_SPANS = "array<struct<start:int,end:int>>"
MIDDLE = "doc_id {kind}, text string, n_words long, items array<string>, word_spans " + _SPANS
RESULT = "doc_id {kind}, n_words long, n_hit long, items array<string>, word_spans " + _SPANS + ", char_spans " + _SPANS


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


def windows(words: list[bytes], size: int) -> set[bytes]:
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}


def pattern_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(pattern, item): the distinct windows of every item, item ids as strings."""
    def rows(part):
        return [[sorted(w.decode("latin-1") for w in windows(normal_words(t), window)) for t in part.column("text").to_pylist()],
                part.column("item")]
    items = benchmark.select(F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"))
    found = map_slices(items, rows, "patterns array<string>, item string")
    return found.select(F.explode("patterns").alias("pattern"), "item").distinct()


def _automaton(key: str, patterns: dict[str, list[str]]):
    """The automaton of a block, built once in each worker process."""
    if key not in _BUILT:
        import ahocorasick
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for p, items in patterns.items():
            a.add_word(f" {p} ", (p.count(" ") + 1, items))
        a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def _sent_blocks(spark, table: DataFrame, block_chars: int):
    """(key, broadcast of pattern -> items) for each block of the pattern table. A block is brought
    to the driver by itself and has about ``block_chars`` characters."""
    table = table.cache()
    chars = table.agg(F.sum(F.length("pattern") + F.length("item"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        patterns = defaultdict(list)
        for r in table.filter(F.pmod(F.xxhash64("pattern"), F.lit(n)) == b).toLocalIterator():
            patterns[r.pattern].append(r.item)
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(dict(patterns))
    table.unpersist()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan_text(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, hit ranges of word numbers (merged), items with an occurring window."""
    words = normal_words(text)
    if not words:
        return 0, [], []
    line = b" " + b" ".join(words) + b" "
    spans, items, starts = [], set(), None
    for end, (n, ids) in automaton.iter(line.decode("latin-1")):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = int(np.searchsorted(starts, end))
        spans.append((last - n, last))
        items.update(ids)
    return len(words), merged(spans), sorted(items)


def char_spans(text: str, word_spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of word numbers as (start, end) code-point offsets in the original text."""
    if not word_spans:
        return []
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in word_spans]


def structs(spans: list[list[tuple[int, int]]]) -> list[list[dict]]:
    return [[{"start": a, "end": b} for a, b in x] for x in spans]


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: its id, ``n_words``, ``n_hit`` (words inside a window), ``items`` (sorted
    ids of the items found), ``word_spans`` and ``char_spans`` (merged hit ranges: word numbers,
    and code-point offsets in the original text)."""
    blocks = list(_sent_blocks(docs.sparkSession, pattern_table(benchmark, window=window), block_chars))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                      F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"),
                      F.array().cast("array<struct<start:int,end:int>>").alias("word_spans"))
    kind = dict(out.dtypes)["doc_id"]
    for b, (key, sent) in enumerate(blocks):
        last = b == len(blocks) - 1

        def rows(part, sent=sent, key=key, last=last):
            ids, texts = part.column("doc_id"), part.column("text")
            seen_items, seen_spans = part.column("items").to_pylist(), part.column("word_spans").to_pylist()
            automaton = _automaton(key, sent.value)
            n_words, items, spans = [], [], []
            for text, old_items, old_spans in zip(texts.to_pylist(), seen_items, seen_spans):
                n, found, hit = scan_text(automaton, text) if len(automaton) else (len(normal_words(text)), [], [])
                n_words.append(n)
                items.append(sorted({*old_items, *hit}) if old_items else hit)
                spans.append(merged([(x["start"], x["end"]) for x in old_spans] + found) if old_spans else found)
            if not last:
                return [ids, texts, n_words, items, structs(spans)]
            return [ids, n_words, [sum(e - a for a, e in x) for x in spans], items, structs(spans),
                    structs([char_spans(t or "", x) for t, x in zip(texts.to_pylist(), spans)])]

        out = map_slices(out, rows, (RESULT if last else MIDDLE).format(kind=kind))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs`` whose text holds no window of the benchmark, with all their columns. Blocks of
    patterns follow each other, each with its own pass over what is left, so a worker builds an automaton once."""
    for key, sent in _sent_blocks(docs.sparkSession, pattern_table(benchmark, window=window), block_chars):
        def run(batches, key=key, sent=sent):
            automaton = _automaton(key, sent.value)
            for batch in batches:
                for part in slices(batch):
                    clean = [not (len(automaton) and scan_text(automaton, t)[1]) for t in part.column(text_col).to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
