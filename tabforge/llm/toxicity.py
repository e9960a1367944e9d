"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A text is cut into short windows of whole words. Each window is compressed with two
dictionaries of equal length: one holds ordinary text and what is peculiar to toxic text, the
other the same ordinary text and filler. What the first saves is due to toxic wording alone. The
savings of a text's windows, against a threshold found on all windows of the sample's ordinary texts, give four features; a
logistic calibration turns them into a score from 0 to 1.

Fitting reads a bounded sample of labelled rows (``sample_rows`` of each class in the order of a
hash of their ids, at most ``sample_chars`` characters of each class), never the texts of the
held-out fold. A text that no longer fits is passed over and the next ones are tried; if no text of a class
fits, its shortest is taken as far as the bound allows. Which wording is peculiar: words that toxic texts hold in many different contexts
(pairs of neighbours, so copies of a text count once) and ordinary texts do not, by a
log-likelihood test against chance. They are the samples of the toxic dictionary.

Cases: a null text is an empty one and has a score; labels that are null or of a class other
than 0 and 1, and labels without a document, are not used; with no labels of one class every
score is 0; repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import map_slices

WINDOW_BYTES = 96
LEVEL = 9
ORDINARY_BYTES = 32768
TOXIC_BYTES = 4096
MIN_CONTEXTS = 5
MIN_LIFT = 5
DICTIONARY_WINDOWS = 60_000
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 24_000_000
FOLDS = 5
_LOWER = bytes(i + 32 if 65 <= i <= 90 else 32 if 9 <= i <= 13 else i for i in range(256))
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def text_windows(text: str | None, size: int = WINDOW_BYTES) -> list[bytes]:
    """Windows of whole words with a space at both ends, of about ``size`` bytes; a longer word
    is cut."""
    out, now, n = [], [], 1
    for w in (text or "").encode("utf-8", "replace").translate(_LOWER).split():
        while len(w) > size:
            out.append(b" " + w[:size] + b" ")
            w = w[size:]
        if n + len(w) + 1 > size and now:
            out.append(b" " + b" ".join(now) + b" ")
            now, n = [], 1
        now.append(w)
        n += len(w) + 1
    if now:
        out.append(b" " + b" ".join(now) + b" ")
    return out


@dataclass
class Model:
    """The two dictionaries, the threshold on a window's saving and the calibration."""
    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 1
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    _run: tuple | None = None

    def __getstate__(self):
        return {**self.__dict__, "_run": None}

    def _compressors(self):
        if self._run is None:
            import zstandard
            filler = bytes(i % 7 for i in range(len(self.toxic)))
            out = []
            for head in (filler, self.toxic):
                raw = zstandard.ZstdCompressionDict(head + self.ordinary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                params = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=WINDOW_BYTES, dict_size=len(head) + len(self.ordinary), write_content_size=0,
                    write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                raw.precompute_compress(compression_params=params)
                out.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress)
            self._run = tuple(out)
        return self._run

    def savings(self, text: str | None) -> np.ndarray:
        """Per window, the bytes that the toxic dictionary saves over the ordinary one."""
        plain, toxic = self._compressors()
        return np.array([len(plain(w)) - len(toxic(w)) for w in text_windows(text)], float)

    def features(self, text: str | None) -> list[float]:
        return self.features_of(self.savings(text))

    def features_of(self, d: np.ndarray) -> list[float]:
        if not len(d):
            return [0.0, 0.0, 0.0, 0.0]
        high = d[d >= self.threshold]
        top = np.sort(d)[-2:]
        return [float(top[-1]), float(top[0]) if len(top) > 1 else 0.0, math.log1p(high.sum()), float(np.clip(d, 0, None).mean())]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        x = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + float(x @ self.weights[1:]))))))


def _contexts(texts: list[str]) -> dict[bytes, int]:
    """Per word, in how many different pairs of neighbours it stands. Texts are kept as one sequence
    of word numbers, 0 between them, so that memory is a few bytes for each word of the sample."""
    number: dict[bytes, int] = {b"": 0}
    seq = array("I", [0])
    for t in texts:
        seq.extend([number.setdefault(w, len(number)) for w in (t or "").encode("utf-8", "replace").translate(_WORDS).split()])
        seq.append(0)
    ids = np.frombuffer(seq, np.uint32)
    at = np.flatnonzero(ids)
    rows = np.column_stack([ids[at], ids[at - 1], ids[at + 1]])
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    counts = np.bincount(rows[new, 0], minlength=len(number))
    return {w: int(counts[i]) for w, i in number.items() if i}


def peculiar_words(toxic: list[str], ordinary: list[str]) -> dict[bytes, int]:
    """Words of toxic texts with their number of contexts there, where that number is beyond
    chance and at least ``MIN_LIFT`` times what ordinary texts would lead one to expect."""
    c1, c0 = _contexts(toxic), _contexts(ordinary)
    n1, n0 = sum(c1.values()), sum(c0.values())
    share = n1 / max(1, n1 + n0)
    least = math.log(len(c1) + len(c0) + 1) + 3
    out = {}
    for word, a in c1.items():
        b = c0.get(word, 0)
        q = a / (a + b)
        if len(word) < 3 or a < MIN_CONTEXTS or q <= share or a / n1 < MIN_LIFT * (b + 1) / max(1, n0):
            continue
        if a * math.log(q / share) + (b * math.log((1 - q) / (1 - share)) if b else 0) >= least:
            out[word] = a
    return out


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of too few samples for its trainer, the samples themselves."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], prior: float | None = None, dictionary_windows: int = DICTIONARY_WINDOWS) -> Model:
    """A model from texts of both classes. ``prior``: share of toxic texts among all, if the two
    lists are not in proportion. The ordinary dictionary is trained on ``dictionary_windows`` windows
    at random; the threshold is found on all windows of the ordinary texts."""
    if not toxic or not ordinary:
        return Model()
    words = peculiar_words(toxic, ordinary)
    spread = [b" " + w + b" " for w, n in sorted(words.items()) for _ in range(min(60, n))]
    spread = [spread[i] for i in np.random.default_rng(7).permutation(len(spread))]
    toxic_samples = [b"".join(spread[i:i + 6]) for i in range(0, len(spread), 6)]
    plain = [w for t in ordinary for w in text_windows(t)]
    plain = [plain[i] for i in np.random.default_rng(7).permutation(len(plain))[:dictionary_windows]]
    model = Model(_trained(ORDINARY_BYTES, plain) if plain else b"", _trained(TOXIC_BYTES, toxic_samples) if toxic_samples else b"")
    if not model.ordinary or not model.toxic:
        return Model()
    savings = [model.savings(t) for t in toxic + ordinary]
    model.threshold = max(1, int(np.quantile(np.concatenate(savings[len(toxic):]), 0.999)) + 1)
    x = np.array([model.features_of(d) for d in savings])
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(ordinary))])
    model.mean, model.scale = x.mean(axis=0).tolist(), np.maximum(x.std(axis=0), 1e-9).tolist()
    weights = _logistic((x - model.mean) / model.scale, y)
    if prior and 0 < prior < 1:
        weights[0] += math.log(prior / (1 - prior)) - math.log(len(toxic) / len(ordinary))
    model.weights = weights.tolist()
    return model


def fold_of(id_col: str):
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def fit_on(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
           dictionary_windows: int = DICTIONARY_WINDOWS) -> Model:
    """Fits on labelled documents outside fold 0. The sample is bounded in rows and characters."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & (fold_of("doc_id") > 0))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample_rows) for k in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    texts = texts.withColumns({"order": order, "hash": F.xxhash64("text")})
    key = ["toxic", "order", "doc_id", "hash"]
    sizes_of = texts.groupBy(*key, F.length("text").alias("chars")).agg(F.count("*").alias("n")).collect()
    taken = {}
    for k in (0, 1):
        rows, left = sorted((r for r in sizes_of if r.toxic == k), key=lambda r: (r.order, r.hash, str(r.doc_id), r.chars)), sample_chars
        for r in rows:
            n = min(r.n, left // r.chars) if r.chars else r.n
            left -= n * r.chars
            if n:
                taken[k, r.doc_id, r.hash, r.chars] = n
        if rows and left == sample_chars and not any(x[0] == k for x in taken):
            r = min(rows, key=lambda r: r.chars)
            taken[k, r.doc_id, r.hash, r.chars] = 1
    if not taken:
        return Model()
    kind = dict(docs.dtypes)["doc_id"]
    picked = docs.sparkSession.createDataFrame([(*x, n) for x, n in taken.items()], f"toxic int, doc_id {kind}, hash long, chars int, n long")
    found = texts.drop("toxic").withColumn("chars", F.length("text")).join(F.broadcast(picked), ["doc_id", "hash", "chars"])
    found = found.groupBy(*key, "chars", "n").agg(F.first("text").substr(1, sample_chars).alias("text")).collect()
    found.sort(key=lambda r: (r.order, r.text))
    by = {k: [r.text for r in found if r.toxic == k for _ in range(r.n)] for k in (0, 1)}
    return fit(by[1], by[0], prior=sizes[1] / (sizes[0] + sizes[1]), dictionary_windows=dictionary_windows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``score``. Every text is scored whole; no shuffle."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and a few numbers

    def rows(part):
        m = sent.value
        return [part.column("doc_id"), [m.score(t) for t in part.column("text").to_pylist()]]

    return map_slices(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rows, f"doc_id {kind}, score double")


def score_column(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score"):
    """The score as a column expression, for filters that keep all columns of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series([m.score(t) for t in texts], dtype=float)

    return scored(F.col(text_col)).alias(name)
