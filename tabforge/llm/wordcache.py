"""Token ids of whole texts as the tokenizers library gives them, through a cache of words.

The vocabulary files used here split text at white space before any merge, so a text's ids are
the ids of its white-space separated chunks in order. Each distinct chunk is encoded by the
library once and gets a number; a text is then a look-up per chunk and one gather from an array of
ids. A cache is bounded in bytes: beyond its limit it is emptied and frequent chunks are learnt
again; chunks over ``LONG_CHUNK`` bytes, as texts without spaces have, are never kept.
"""

from __future__ import annotations

import os
import re
from unicodedata import is_normalized

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_WS = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))
_WS_LOWER = bytes(32 if i in (9, 10, 11, 12, 13) else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: How special tokens of the vocabulary begin; a text that holds it is not lower-cased.
_SPECIAL = b"<|"
#: A mark between a word and a space; the vocabulary cuts there too.
_WORD_MARK = re.compile(rb"(?<=[a-z])([.,;:!?]) ")
#: Letters, then ASCII marks: such a chunk is cut there by the vocabulary too.
_LETTERS_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-;=-@\[-^`{}~]+)")
LONG_CHUNK = 256
#: Estimated bytes of a kept chunk besides its text and its ids.
_ENTRY_BYTES = 120
_CACHES: dict[str, "WordCache"] = {}


def word_cache(path: str) -> "WordCache":
    """The cache of this worker process for a tokenizer file."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


class _Numbers(dict):
    """Chunk -> number. An unknown chunk gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk):
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class WordCache:
    def __init__(self, path: str, limit_bytes: int = 48 << 20):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.limit = limit_bytes
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.bytes = _Numbers(), 0
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_ids = self.n_chunks = 0

    @staticmethod
    def chunks(text: str) -> list[bytes]:
        """White-space chunks, A-Z lower-cased (as the vocabulary does itself, so more chunks are shared)
        and words cut from a mark behind them, unless the text has marks of special tokens."""
        raw = text.encode("utf-8", "replace")
        if _SPECIAL in raw:
            return raw.translate(_WS).split()
        return _WORD_MARK.sub(rb" \1 ", raw.translate(_WS_LOWER)).split()

    def encode_all(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts after each other, each with ``end_id`` behind it, and where
        each text begins; ``offsets`` has one entry more."""
        if self.bytes > self.limit:
            self._empty()
        numbers, mark = self.numbers, None
        parts, counts = [], []
        if end_id is not None:
            mark = b" end %d" % end_id  # no chunk has a space
            if mark not in numbers:
                numbers[mark] = len(numbers)
                self._keep([np.array([end_id], "<u4")])
        for t in texts:
            found = self.chunks(t)
            if mark is not None:
                found.append(mark)
            parts.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
            counts.append(len(found))
        if numbers.new:
            self._learn(numbers.new)
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - ends + sizes, sizes)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        long = [c for c in numbers.new if len(c) > LONG_CHUNK]
        numbers.new = []
        if long:
            self._empty()
        return ids, offsets

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers."""
        ids, offsets = self.encode_all(texts)
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]

    def _keep(self, found: list[np.ndarray]) -> None:
        """Ids of the next chunks, in the order of their numbers."""
        self._append(np.concatenate(found), np.array([len(x) for x in found], np.int64))

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_chunks + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        where = slice(self.n_chunks, self.n_chunks + len(sizes))
        self.starts[where], self.sizes[where] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        self.n_ids += len(ids)
        self.n_chunks += len(sizes)

    def _learn(self, new: list[bytes]) -> None:
        """Chunks of letters, and of letters with marks behind them, are encoded together as one text with
        spaces between (one library call for thousands of them), all others one by one."""
        self.bytes += sum(map(len, new)) + _ENTRY_BYTES * len(new)
        words: list[str] = []  # as they stand in the text
        pieces, alone = np.zeros(len(new), np.int64), []
        for i, w in enumerate(new):
            if w.isalpha():
                words.append(w.decode())
                pieces[i] = 1
                continue
            s = w.decode("utf-8", "replace")
            m = _LETTERS_MARKS.fullmatch(s)
            if s.isalpha() and is_normalized("NFC", s):
                words.append(s)
                pieces[i] = 1
            elif m and m[1].isalpha() and (s.isascii() or is_normalized("NFC", m[1])):
                words.append(f"{m[1]} {m[2]}")
                pieces[i] = 2
            else:
                alone.append(i)
        together = np.flatnonzero(pieces)
        sizes, parts = np.zeros(len(new), np.int64), []
        for a in range(0, len(together), 4096):
            mine = together[a:a + 4096]
            ids = self._encode([" ".join(words[a:a + 4096])])[0]
            last = np.flatnonzero(self.ends[ids])  # of each piece
            if len(last) == pieces[mine].sum() and len(ids) and last[-1] == len(ids) - 1:
                chunk_ends = last[np.cumsum(pieces[mine]) - 1] + 1
                sizes[mine] = np.diff(chunk_ends, prepend=0)
                parts.append((mine, ids))
            else:
                alone.extend(mine.tolist())
        alone.sort()
        for a in range(0, len(alone), 4096):
            mine = np.array(alone[a:a + 4096])
            found = self._encode([new[i].decode("utf-8", "replace") for i in mine])
            sizes[mine] = [len(x) for x in found]
            parts.append((mine, np.concatenate(found)))
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]), "<u4")
        for mine, ids in parts:
            n = sizes[mine]
            to = np.arange(int(n.sum())) + np.repeat((ends - sizes)[mine] - np.cumsum(n) + n, n)
            out[to] = ids
        self._append(out, sizes)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
