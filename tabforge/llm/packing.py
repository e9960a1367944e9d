"""Vector bin packing of token sequences for instruction data.

An example needs room in three limits at once: tokens, segments (one) and loss-bearing tokens.
A sequence is filled greedily: of the waiting examples that fit, the one whose demand has the
largest dot product with the room left (both as shares of the limits) goes in. When none fits
and the gap is at least ``min_cut`` tokens, a waiting example is cut to fill it; examples longer
than a sequence are cut into full sequences first. What is left of an example waits again.

Work is local to a task and the pool of waiting examples is bounded, so there is no shuffle; a
task ends with at most a few sequences that are not full. Sequences are numbered by task, then
in order, and a retried task makes the same ones from the same rows.

Cases: a null or empty text still has its end id and is packed; repeated rows are packed each;
a null id is kept; a mask of another length than the ids is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .wordcache import word_cache

POOL = 1024
SEQUENCES_PER_TASK = 1 << 33


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Example:
    """A run of ids of one document. ``mask`` has a byte for each id, 1 where it bears loss;
    None: all do."""
    doc: object
    start: int
    ids: np.ndarray
    total: int
    mask: np.ndarray | None = None

    def __post_init__(self):
        self.loss = len(self.ids) if self.mask is None else int(self.mask.sum())

    def split(self, n: int) -> tuple["Example", "Example | None"]:
        if n >= len(self.ids):
            return self, None
        m = self.mask
        return (Example(self.doc, self.start, self.ids[:n], self.total, None if m is None else m[:n]),
                Example(self.doc, self.start + n, self.ids[n:], self.total, None if m is None else m[n:]))


def prefix_that_fits(x: Example, tokens: int, loss: int) -> int:
    """Longest prefix of ``x`` within both rooms."""
    n = min(tokens, len(x.ids))
    if x.mask is None:
        return min(n, loss)
    over = np.flatnonzero(np.cumsum(x.mask[:n]) > loss)
    return int(over[0]) if len(over) else n


def pack(examples: Iterable[Example], limits: Limits, pool: int = POOL, min_cut: int = 16) -> Iterator[list[Example]]:
    """Sequences of examples; every id of every example is in exactly one place."""
    bound = np.array([limits.tokens, limits.segments, limits.loss], float)
    waiting: list[Example | None] = [None] * pool
    need = np.full((pool, 3), np.inf)
    free, source, ended = list(range(pool - 1, -1, -1)), iter(examples), False

    def wait(x: Example) -> None:
        i = free.pop()
        waiting[i] = x
        need[i] = len(x.ids) / bound[0], 1 / bound[1], x.loss / bound[2]

    def take(i: int) -> Example:
        x, waiting[i] = waiting[i], None
        need[i] = np.inf
        free.append(i)
        return x

    while True:
        while not ended and len(free) > 1:
            x = next(source, None)
            if x is None:
                ended = True
                break
            while x is not None and (len(x.ids) > limits.tokens or x.loss > limits.loss):
                head, x = x.split(max(1, prefix_that_fits(x, limits.tokens, limits.loss)))
                yield [head]
            if x is not None and len(x.ids):
                wait(x)
        if len(free) == pool:
            return
        room, used, sequence = np.ones(3), np.zeros(3), []
        while True:
            fits = (need <= room + 1e-9).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, np.where(fits[:, None], need, 0) @ room, -1)))
                x = take(i)
            else:
                left = limits.tokens - int(used[0])
                most = int(np.argmax(np.where(np.isfinite(need[:, 0]), need[:, 0], -1)))
                if left < min_cut or waiting[most] is None or used[1] >= limits.segments:
                    break
                n = prefix_that_fits(waiting[most], left, limits.loss - int(used[2]))
                if n < 1:
                    break
                x, rest = take(most).split(n)
                if rest is not None:
                    wait(rest)
            sequence.append(x)
            used += len(x.ids), 1, x.loss
            room = 1 - used / bound
            if used[0] >= limits.tokens:
                break
        yield sequence


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id",
                   text_col: str = "text", mask_col: str | None = None, pool: int = POOL) -> DataFrame:
    """Per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``loss_tokens``, ``sequence_id``, ``offset``.

    ``mask_col``: binary column with a byte per id of the text (1: bears loss); the end id bears
    loss. Without it every id does."""
    kind = dict(docs.dtypes)[id_col]
    schema = pa.schema([("doc_id", pa.null()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def examples(batches, types):
        cache = word_cache(tokenizer)
        for batch in batches:
            types.append(batch.schema.field("doc_id").type)
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                masks = part.column("mask").to_pylist() if mask_col else [None] * len(texts)
                all_ids, at = cache.encode_all(texts, end_id)
                for doc, a, b, m in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), masks):
                    ids = all_ids[a:b].copy()  # a waiting example must not hold its whole batch
                    if m is not None:
                        m = np.append(np.frombuffer(m, np.uint8), np.uint8(1))
                        if len(m) != len(ids):
                            raise ValueError(f"document {doc}: {len(m) - 1} mask bytes for {len(ids) - 1} ids")
                    yield Example(doc, 0, ids, len(ids), m)

    def run(batches):
        first, rows, types = TaskContext.get().partitionId() * SEQUENCES_PER_TASK, [], []

        def made():
            out = schema.set(0, pa.field("doc_id", types[0]))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for n, sequence in enumerate(pack(examples(batches, types), limits, pool)):
            at = 0
            for x in sequence:
                rows.append((x.doc, x.start, len(x.ids), x.ids.tobytes(), x.total, x.loss, first + n, at))
                at += len(x.ids)
            if len(rows) >= 2000:
                yield made()
                rows.clear()
        if rows:
            yield made()

    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")] + ([F.col(mask_col).alias("mask")] if mask_col else [])
    return docs.select(*cols).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
                                              "loss_tokens long, sequence_id long, offset long")


def padding(tokens_in_sequence: int, limit: int) -> int:
    """Padding of a sequence: up to the limit, none at a power of two."""
    return 0 if tokens_in_sequence & (tokens_in_sequence - 1) == 0 else limit - tokens_in_sequence


def mean_fill(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: sequences, tokens and the share of padded room that holds tokens."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    room = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, F.col("n")).otherwise(F.lit(limits.tokens))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), (F.sum("n") / F.sum(room)).alias("fill"))
