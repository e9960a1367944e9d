"""Token counts at every prefix of a text, by dynamic programming over a BPE vocabulary.

The vocabulary (a sentencepiece BPE model without normalisation rules, with byte fallback)
writes a space as U+2581 and puts one before the text. No piece has that mark after another
character, so a text is cut before each mark into segments that never merge with each other.
Within a segment the count at each prefix follows from shorter prefixes: ``count[i] =
count[i - len(t)] + 1`` where ``t`` is the last token of the encoding of the prefix. ``t`` is the
longest vocabulary piece ending at ``i`` that may stand after the last token of the prefix before it:
two adjacent tokens are final exactly if no merge crosses their border while both are built
(``Bpe.may_follow``). Pieces that end at ``i`` are found by walking back from it in a trie of reversed
pieces, so a segment without spaces costs what its pieces do, however long it is. Each distinct segment is
solved once per worker; a text is a look-up per segment and a running sum. What is kept is bounded in bytes,
and segments over ``LONG_SEGMENT`` code points are never kept.

The result answers any question on prefixes without encoding again: ``count_at`` and ``cut_at``.
Counts are per code point of the text: ``encode(text[:i])`` has ``count_at(i)`` tokens.

Cases: a null text is an empty one (0 tokens); repeated rows are counted each; a lone or
repeated space, line ends, bytes without a piece and literal U+2581 count as the library counts
them; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

MARK = "\u2581"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
LONG_SEGMENT = 256
#: Words share beginnings: the states of those of such lengths, in code points, are kept, at most so many.
BEGINNINGS, MAX_BEGINNINGS = (8, 5), 60_000
#: Estimated bytes of a kept segment besides its text and its counts.
_ENTRY_BYTES = 150
_MODELS: dict[str, "Bpe"] = {}


def bpe(path: str) -> "Bpe":
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


class _Numbers(dict):
    """Segment -> number. An unknown segment gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, segment):
        self[segment] = n = len(self)
        self.new.append(segment)
        return n


class Bpe:
    """Pieces of a sentencepiece BPE model with their ranks, and the solved segments."""

    def __init__(self, path: str, limit_bytes: int = 128 << 20):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.vocab_size()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        order = sorted(plain, key=lambda i: (-lib.get_score(i), i))
        self.pieces = [lib.id_to_piece(i) for i in order]
        self.rank = {piece: r for r, piece in enumerate(self.pieces)}
        self.longest = max(map(len, self.rank))
        self.trie: dict = {}
        for r, piece in enumerate(self.pieces):
            node = self.trie
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = r
        self.spines: dict[str, tuple[list[str], list[str]]] = {}
        self.pairs: dict[int, bool] = {}
        self.beginnings: dict[str, tuple] = {}
        self.limit = limit_bytes
        self.runs = [0]
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.bytes = _Numbers(), 0
        self.counts_of, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_counts = self.n_segments = 0

    def spine(self, piece: str) -> tuple[list[str], list[str]]:
        """What stands at the left and at the right edge of ``piece`` while it is built, from a
        single character up to the whole; empty lists if its characters do not merge into it."""
        known = self.spines.get(piece)
        if known is None:
            parts = list(piece)
            left, right = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best = min(((self.rank.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
                if best is None:
                    left = right = []
                    break
                i = best[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    left.append(parts[0])
                if i == len(parts) - 1:
                    right.append(parts[-1])
            known = self.spines[piece] = (left, right)
        return known

    def may_follow(self, first: int, second: int) -> bool:
        """Whether two tokens, given by rank, stay two tokens when they stand side by side."""
        key = first * len(self.pieces) + second
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b = self.pieces[first], self.pieces[second]
        rank, none = self.rank, len(self.rank) + 1
        right, left = self.spine(a)[1], self.spine(b)[0]
        ok = bool(right and left)
        i = j = 0
        while ok:
            cross = rank.get(right[i] + left[j], none)
            grow_a = rank[right[i + 1]] if i + 1 < len(right) else none
            grow_b = rank[left[j + 1]] if j + 1 < len(left) else none
            if cross < grow_a and cross <= grow_b and cross < none:
                ok = False
            elif grow_a == none and grow_b == none:
                break
            elif grow_a <= grow_b:
                i += 1
            else:
                j += 1
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def counts(self, segment: str) -> list[int]:
        """Token count at each non-empty prefix of a segment (at most one leading mark)."""
        return self.states(segment)[1]

    def states(self, segment: str) -> tuple[list[int], list[int]]:
        """For each non-empty prefix: length of its last token (0: bytes) and token count."""
        root, pairs, width, kept = self.trie, self.pairs, len(self.pieces), self.beginnings
        for short in BEGINNINGS:
            known = kept.get(segment[:short]) if len(segment) > short else None
            if known is not None:
                size, count, last = map(list, known)
                break
        else:
            size, count, last = [0], [0], [-1]
        for i in range(len(size), len(segment) + 1):
            node, k, found = root, i, []
            while k:
                node = node.get(segment[k - 1])
                if node is None:
                    break
                k -= 1
                r = node.get("")
                if r is not None:
                    found.append((k, r))
            for k, r in reversed(found):  # the longest first
                before = last[k]
                if before >= 0:
                    ok = pairs.get(before * width + r)
                    if ok is None:
                        ok = self.may_follow(before, r)
                else:
                    ok = k > 0 or bool(self.spine(self.pieces[r])[0])
                if ok:
                    size.append(i - k)
                    count.append(count[k] + 1)
                    last.append(r)
                    break
            else:
                size.append(0)
                count.append(count[i - 1] + len(segment[i - 1].encode("utf-8", "replace")))
                last.append(-1)
        for short in BEGINNINGS:
            if len(segment) > short and segment[:short] not in kept:
                kept[segment[:short]] = (tuple(size[:short + 1]), tuple(count[:short + 1]), tuple(last[:short + 1]))
        if len(kept) > MAX_BEGINNINGS:
            kept.clear()
        return size[1:], count[1:]

    def run(self, n: int) -> int:
        """Tokens of ``n`` marks with nothing behind them: the library's own count up to four
        times the longest piece, then one token for each further longest piece."""
        while len(self.runs) <= min(n, 4 * self.longest):
            k = len(self.runs)
            self.runs.append(len(self.library.encode(" " * (k - 1))) if k > 1 else 1)
        if n < len(self.runs):
            return self.runs[n]
        over = -(-(n - len(self.runs) + 1) // self.longest)
        return self.runs[n - over * self.longest] + over

    def solve(self, segment: str) -> list[int]:
        """Counts of a segment with any number of leading marks. Merges of marks come after all
        others, so the last mark joins the word if a piece of it begins with that mark."""
        marks = len(segment) - len(segment.lstrip(MARK))
        if marks < 2:
            return self.counts(segment)
        tail = segment[marks - 1:]
        size, inner = self.states(tail)
        mark_alone = [n == 1 for n in size]  # whether the first token of a prefix is the mark alone
        for i in range(1, len(tail)):
            if size[i] == 0:
                mark_alone[i] = mark_alone[i - 1]
            elif size[i] <= i:
                mark_alone[i] = mark_alone[i - size[i]]
        out = [self.run(k) for k in range(1, marks + 1)]
        for alone, n in zip(mark_alone[1:], inner[1:]):
            out.append(self.run(marks) + n - 1 if alone else self.run(marks - 1) + n)
        return out

    def _learn(self, new: list[str]) -> None:
        solved = [self.solve(x) for x in new]
        sizes = np.array([len(x) for x in solved], np.int64)
        flat = np.fromiter((c for x in solved for c in x), np.uint32, int(sizes.sum()))
        while self.n_counts + len(flat) > len(self.counts_of):
            self.counts_of = np.concatenate([self.counts_of, np.zeros_like(self.counts_of)])
        while self.n_segments + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.counts_of[self.n_counts:self.n_counts + len(flat)] = flat
        where = slice(self.n_segments, self.n_segments + len(sizes))
        self.starts[where], self.sizes[where] = self.n_counts + np.cumsum(sizes) - sizes, sizes
        self.n_counts += len(flat)
        self.n_segments += len(sizes)
        self.bytes += 6 * len(flat) + _ENTRY_BYTES * len(new)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count at each non-empty prefix of ``text``, one per code point."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.bytes > self.limit:
            self._empty()
        parts = _SEGMENT.findall(MARK + text.replace(" ", MARK))
        numbers = self.numbers
        at = np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts))
        if numbers.new:
            self._learn(numbers.new)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        inner = self.counts_of[np.arange(int(ends[-1])) + np.repeat(self.starts[at] - ends + sizes, sizes)]
        before = np.concatenate([[0], np.cumsum(inner[ends - 1], dtype=np.int64)[:-1]])
        if numbers.new:
            if max(map(len, numbers.new)) > LONG_SEGMENT:
                self._empty()
            numbers.new = []
        counts = inner + np.repeat(before, sizes)
        return counts[1:].astype(np.uint32)  # the mark put before the text is not a code point of it


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as a compressed list of steps, one byte each, or four if one does not fit, which the first byte tells."""
    steps = np.diff(counts.astype(np.int64), prepend=0)
    wide = len(steps) > 0 and bool((np.abs(steps) > 127).any())
    return (b"\4" if wide else b"\1") + zlib.compress(steps.astype("<i4" if wide else "i1").tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob[1:]), "<i4" if blob[0] == 4 else "i1"), dtype=np.int64)


def count_at(blob: bytes, i: int) -> int:
    """Tokens of the first ``i`` code points."""
    return int(unpack_counts(blob)[i - 1]) if i > 0 else 0


def cut_at(blob: bytes, budget: int) -> int:
    """The longest prefix, in code points, that has at most ``budget`` tokens."""
    return cut_of(unpack_counts(blob), budget)


def cut_of(counts: np.ndarray, budget: int) -> int:
    if len(counts) and counts[-1] <= budget:
        return len(counts)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """Per row of ``docs``: its id, ``n_bytes``, ``n_chars``, ``n_tokens`` and ``prefix_counts``, the packed
    counts of all prefixes; with ``budget`` also ``fits``, the longest prefix in code points of at most so
    many tokens, read from the counts. Rows are independent: no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def rows(part):
        solver = bpe(model)
        texts = [t or "" for t in part.column("text").to_pylist()]
        counts = [solver.prefix_counts(t) for t in texts]
        blobs = [pack_counts(c) for c in counts]
        out = [part.column("doc_id"), [len(t.encode("utf-8", "replace")) for t in texts], [len(c) for c in counts],
               [int(c[-1]) if len(c) else 0 for c in counts], blobs]
        return out if budget is None else out + [[cut_of(c, budget) for c in counts]]

    return map_slices(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rows,
                      f"doc_id {kind}, n_bytes long, n_chars long, n_tokens long, prefix_counts binary" + ", fits long" * (budget is not None))
