"""Operator 3: token ids in binary files of independent zstandard frames.

A file holds, in this order: one zstandard frame per group of documents (each frame with its own content checksum),
a skippable frame with the document index, and a skippable frame with the seek table of the public zstandard
seekable format (compressed size, decompressed size and the low half of XXH64 for each frame, then the footer).
The document index says for each document its doc_id, frame, offset in the frame and number of ids, so a reader
opens a file at its end and decompresses only the frames it wants.

Documents are range-partitioned by doc_id, so the files in order hold the corpus in ascending doc_id order. One task
writes one file under a name of its own and reports it; only reported files count, so a retried or lost task leaves
at most an unused file. Where documents start in the whole corpus follows from one row per file.

Defined results: null text is empty text; a null doc_id comes first; repeated rows are stored each; an empty table
gives no files and no rows; other input columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices, texts_of

#: Decompressed bytes after which a frame is closed.
FRAME_BYTES = 256 << 10
#: Fixed values of the zstandard seekable format: magic numbers of the index frame, the seek table and its footer.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_ENTRY, _DOC = struct.Struct("<III"), struct.Struct("<?qIQQ")
_FILES = "part int, path string, n_docs long, n_ids long, n_bytes long"


def _open(path: str, mode: str):
    """A file of any store that pyarrow knows; a plain path is a local one."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    if mode == "rb":
        return system.open_input_file(inner)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


class FrameWriter:
    """Writes documents in the order given; ``close`` adds the index and the seek table."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self._stream, self._compress = stream, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self._frame, self._held, self._entries, self._docs = [], 0, [], []
        self.n_ids = self.n_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._held and self._held + len(ids) > FRAME_BYTES:
            self._flush()
        self._docs.append(_DOC.pack(doc_id is not None, doc_id or 0, len(self._entries), self._held, len(ids) // 4))
        self._frame.append(ids)
        self._held += len(ids)
        self.n_ids += len(ids) // 4

    def _flush(self) -> None:
        import xxhash

        data = b"".join(self._frame)
        packed = self._compress.compress(data)
        self._put(packed)
        self._entries.append(_ENTRY.pack(len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self._frame, self._held = [], 0

    def _put(self, data: bytes) -> None:
        self._stream.write(data)
        self.n_bytes += len(data)

    def close(self) -> int:
        if self._held:
            self._flush()
        index = zlib.compress(b"".join(self._docs), 6)
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(self._entries) + struct.pack("<IBI", len(self._entries), 0x80, FOOTER_MAGIC)
        self._put(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self._stream.close()
        return len(self._docs)


class FrameReader:
    """Reads the end of a file first, then single frames on demand; a wrong checksum raises ValueError."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * count, 12 * count)
        self.frames, begin = [], 0
        for packed, plain, check in _ENTRY.iter_unpack(table):
            self.frames.append((begin, packed, plain, check))
            begin += packed
        magic, length = struct.unpack("<II", self._at(begin, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index behind the frames")
        self.docs = [(doc_id if known else None, frame, offset, n) for known, doc_id, frame, offset, n in _DOC.iter_unpack(zlib.decompress(self._at(begin + 8, length)))]

    def _at(self, begin: int, size: int) -> bytes:
        self._source.seek(begin)
        return self._source.read(size)

    def frame(self, number: int) -> bytes:
        import xxhash
        import zstandard

        begin, packed, plain, check = self.frames[number]
        try:
            data = zstandard.ZstdDecompressor().decompress(self._at(begin, packed), max_output_size=plain)
        except zstandard.ZstdError as error:
            raise ValueError(f"frame {number} is damaged: {error}") from None
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} has a wrong checksum")
        return data

    def documents(self, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, bytes]]:
        held, data = -1, b""
        for doc_id, frame, offset, n in self.docs:
            if wanted is None or doc_id in wanted:
                if n and frame != held:
                    held, data = frame, self.frame(frame)
                yield doc_id, data[offset : offset + 4 * n] if n else b""


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode and write; returns one row per file: part, path, n_docs, n_ids, n_bytes."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        from .tokens import encoder

        part, writer, path = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for few in slices(batch):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                    writer = FrameWriter(_open(path, "wb"))
                for doc_id, ids in zip(few.column("doc_id").to_pylist(), encoder(tokenizer).encode(few.column("text").to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            n_docs = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [writer.n_ids], "n_bytes": [writer.n_bytes]})

    ordered = texts_of(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(write, _FILES), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in the corpus), n_tokens, ids_crc32, ids_bytes left in the files."""
    spark: SparkSession = files.sparkSession
    listed = files.orderBy("part").select("part", "path", "n_ids").collect()  # one row per file
    starts, total = [], 0
    for row in listed:
        starts.append((row["path"], total))
        total += row["n_ids"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with _open(path, "rb") as source:
                    rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for doc_id, ids in FrameReader(source).documents():
                        for column, value in zip(rows.values(), (doc_id, start, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            column.append(value)
                        start += len(ids) // 4
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    slots = max(1, len(starts))
    rows = spark.createDataFrame(starts, "path string, start long").repartition(slots)
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
