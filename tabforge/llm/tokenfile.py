"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout (the public seekable zstandard format, with an index of documents before the table):

* data frames: each an independent zstandard frame of at most ``FRAME_IDS`` ids, as little-endian
  16-bit integers if the vocabulary fits, else 32-bit; documents follow each other and may cross
  from a frame into the next;
* a skippable frame with the document index: width of an id, number of documents, then columns
  of ids (64-bit; a bitmap marks null), first positions and lengths in the file's ids;
* a skippable frame with the seek table: per data frame its compressed size, its size and the
  low 32 bits of the XXH64 of its content; then the number of frames, a flag byte and a magic
  number, so a reader finds everything from the end of the file.

``write_tokens`` writes one file per task, ascending by document id across files, and a manifest
table. A task names its file with a fresh random part and only files in the manifest count, so
retried and speculative attempts do no harm. ``read_tokens`` reads whole files in parallel;
``TokenFile.read`` fetches single documents, decompressing only the frames that hold them, and
checks the checksum of each.

Cases: a null or empty text has only its end id; a null document id sorts first; rows with the
same id follow each other in the order of a hash of their texts; an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import slices
from .wordcache import word_cache

FRAME_IDS = 1 << 17
# Fixed values of the public seekable zstandard format.
SKIPPABLE = 0x184D2A5E
INDEX_FRAME = 0x184D2A5D
SEEKABLE = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder named by a URI (a Hadoop or object store, or a local path)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _checksum(raw: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(raw, 0) & 0xFFFFFFFF


class TokenFileWriter:
    """Streams documents into a file; memory is one frame and 24 bytes for each document."""

    def __init__(self, out, wide: bool, level: int = 1):
        import zstandard
        self.out, self.dtype, self.packer = out, "<u4" if wide else "<u2", zstandard.ZstdCompressor(level=level)
        self.waiting, self.n_waiting = [], 0
        self.frames, self.docs, self.starts, self.lengths, self.position = [], [], [], [], 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.starts.append(self.position)
        self.lengths.append(len(ids))
        self.position += len(ids)
        ids = ids.astype(self.dtype)
        while len(ids):
            part, ids = ids[:FRAME_IDS - self.n_waiting], ids[FRAME_IDS - self.n_waiting:]
            self.waiting.append(part)
            self.n_waiting += len(part)
            if self.n_waiting == FRAME_IDS:
                self._frame()

    def _frame(self) -> None:
        raw = np.concatenate(self.waiting).tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), _checksum(raw)))
        self.waiting, self.n_waiting = [], 0

    def close(self) -> None:
        if self.n_waiting:
            self._frame()
        null = np.array([d is None for d in self.docs], np.uint8)
        columns = [np.array([d or 0 for d in self.docs], "<i8"), np.array(self.starts, "<u8"), np.array(self.lengths, "<u8")]
        index = self.packer.compress(struct.pack("<II", np.dtype(self.dtype).itemsize, len(self.docs)) + null.tobytes()
                                     + b"".join(c.tobytes() for c in columns))
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)


class TokenFile:
    """Random access to a file: only the end of it and the frames asked for are read."""

    def __init__(self, uri: str):
        import zstandard
        fs, path = open_store(uri)
        self.file = fs.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor()
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags != CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, end - 9 - 12 * n), "<u4").reshape(n, 3)
        self.packed, self.sizes, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.packed, dtype=np.int64)])
        head = int(self.at[-1])
        magic, size = struct.unpack("<II", self.file.read_at(8, head))
        if magic != INDEX_FRAME:
            raise ValueError(f"{uri} has no document index")
        index = self.unpack.decompress(self.file.read_at(size, head + 8))
        self.width, m = struct.unpack("<II", index[:8])
        body = memoryview(index)[8:]
        self.null = np.frombuffer(body[:m], np.uint8)
        self.docs, self.starts, self.lengths = (np.frombuffer(body[m + 8 * m * k:m + 8 * m * (k + 1)], t) for k, t in enumerate(("<i8", "<u8", "<u8")))
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def frame(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            raw = self.unpack.decompress(self.file.read_at(int(self.packed[k]), int(self.at[k])), max_output_size=int(self.sizes[k]))
            if len(raw) != self.sizes[k] or _checksum(raw) != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.kept = (k, np.frombuffer(raw, f"<u{self.width}"))
        return self.kept[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the file's ``i``-th document."""
        a, parts = int(self.starts[i]), []
        b = a + int(self.lengths[i])
        for k in range(a // FRAME_IDS, -(-b // FRAME_IDS)):
            parts.append(self.frame(k)[max(0, a - k * FRAME_IDS):b - k * FRAME_IDS])
        return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")

    def read(self, doc: int) -> list[np.ndarray]:
        """Ids of every document with this id."""
        return [self.ids(int(i)) for i in np.flatnonzero((self.docs == doc) & (self.null == 0))]

    def close(self) -> None:
        self.file.close()


@dataclass
class TokenStore:
    """Where the files are: ``manifest`` has (path, part, first_doc, n_docs, n_ids) per file."""
    path: str
    manifest: DataFrame


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> TokenStore:
    """Tokenises and writes ``docs`` into ``path``, by default a new folder under the shared
    checkpoint folder. Ids are range-partitioned, so files ascend by id; a hash of the text and
    a row number share out the rows of one hot id."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    rows = rows.repartitionByRange("doc_id", "tie", "share")
    rows = rows.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    out = pa.schema([("path", pa.string()), ("part", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        part, cache, writer = TaskContext.get().partitionId(), word_cache(tokenizer), None
        for batch in batches:
            for rows in slices(batch):
                ids, at = cache.encode_all([t or "" for t in rows.column("text").to_pylist()], end_id)
                for doc, a, b in zip(rows.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    if writer is None:
                        fs, folder = open_store(path)
                        fs.create_dir(f"{folder}/files", recursive=True)
                        name = f"files/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                        sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        writer = TokenFileWriter(sink, wide=cache.tok.get_vocab_size() > 65536)
                    writer.add(doc, ids[a:b])
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{path}/{name}", "part": part, "first_doc": writer.docs[0],
                                               "n_docs": len(writer.docs), "n_ids": writer.position}], schema=out)

    rows.mapInArrow(run, "path string, part int, first_doc long, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    return open_tokens(spark, path)


def open_tokens(spark: SparkSession, path: str) -> TokenStore:
    return TokenStore(path, spark.read.schema("path string, part int, first_doc long, n_docs long, n_ids long").parquet(f"{path}/manifest"))


def read_tokens(store: TokenStore, ids: bool = True) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` and, if ``ids``, the ids as little-endian 32-bit integers. The
    running total is over files: one short row for each."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = store.manifest.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids
    out = pa.schema(fields)

    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                file, rows = TokenFile(f["path"]), []
                for i in range(len(file.docs)):
                    raw = file.ids(i).tobytes()
                    rows.append((None if file.null[i] else int(file.docs[i]), f["before"] + int(file.starts[i]), len(raw) // 4,
                                 zlib.crc32(raw), raw)[:len(out)])
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), out)], schema=out)
                        rows.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), out)], schema=out)
                file.close()

    n = max(1, store.manifest.count())
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
