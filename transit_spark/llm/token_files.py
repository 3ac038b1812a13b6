"""Binary token files: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is a plain zstandard stream. Its data frames hold the ids of whole documents as little-endian unsigned 32-bit
integers, about ``FRAME_IDS`` ids a frame (a longer document has a frame of its own). A skippable frame follows with the
document table: a zstandard frame of the number of documents, their ids, flags for null ids and lengths. Last comes
the seek table of the public seekable format: for each frame its compressed size, its size and the low 32 bits of the XXH64
of its content, then the number of frames, a flag byte and a magic number. A reader looks at the file's end, finds the
frames of the documents that it wants, and decompresses those alone.

Documents are dealt by ranges of ids, each range written to one file in ascending order (null ids first, equal ids in
order of their text), so that the files in order hold the whole corpus in order. A task that is repeated writes a file of
another name; only files that the stored manifest names are read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transit_spark.llm.tokens import encoder
from transit_spark.session import materialise, scratch_path

FRAME_IDS = 1 << 16
BATCH_TEXTS = 256
LEVEL = 1
# Fixed values of the public zstandard seekable format.
SEEK_FRAME = 0x184D2A5E
TABLE_FRAME = 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


class FrameWriter:
    """Writes one file to an open binary stream."""

    def __init__(self, sink) -> None:
        self.sink, self.compress = sink, zstandard.ZstdCompressor(level=LEVEL).compress
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n and self.n + len(ids) > FRAME_IDS:
            self._frame()
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.n += len(ids)

    def _frame(self) -> None:
        raw = np.concatenate(self.waiting).astype("<u4").tobytes()
        packed = self.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.n = [], 0

    def close(self) -> None:
        if self.waiting:
            self._frame()
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        table = self.compress(struct.pack("<Q", len(ids)) + ids.tobytes() + null.tobytes() + np.array(self.sizes, "<u8").tobytes())
        self.sink.write(struct.pack("<II", TABLE_FRAME, len(table)) + table)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<III", TABLE_FRAME, 4, len(table) + 8))  # where the document table begins, from here
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads documents of one file by random access."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        at = size - 9 - 12 * n
        self.frames = np.frombuffer(source.read_at(12 * n, at), "<u4").reshape(-1, 3)
        pointer = at - 8 - 12
        back = struct.unpack("<III", source.read_at(12, pointer))[2]
        table = zstandard.ZstdDecompressor().decompress(source.read_at(back - 8, pointer - back + 8))
        docs = struct.unpack_from("<Q", table)[0]
        self.doc_ids = np.frombuffer(table, "<i8", docs, 8)
        self.null = np.frombuffer(table, np.uint8, docs, 8 + 8 * docs).astype(bool)
        self.sizes = np.frombuffer(table, "<u8", docs, 8 + 9 * docs).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.frame_ends = np.cumsum(self.frames[:, 1].astype(np.int64)) // 4
        self.offsets = np.concatenate(([0], np.cumsum(self.frames[:, 0].astype(np.int64))))

    def frame(self, k: int) -> np.ndarray:
        packed, size, checksum = (int(x) for x in self.frames[k])
        raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, int(self.offsets[k])), max_output_size=size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it in the file, its ids); frames without a wanted document are left alone."""
        last, ids = -1, None
        for d, end in enumerate(self.ends.tolist()):
            doc_id = None if self.null[d] else int(self.doc_ids[d])
            if wanted is not None and doc_id not in wanted:
                continue
            begin = end - int(self.sizes[d])
            k = int(np.searchsorted(self.frame_ends, begin, side="right"))
            if k != last:
                last, ids = k, self.frame(k)
            base = int(self.frame_ends[k]) - len(ids)
            yield doc_id, begin, ids[begin - base : end - base]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, of a plain path, or of ``file:/path`` as Spark writes it."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return pafs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encodes and writes all texts; returns the stored manifest (file_no, path, n_docs, n_ids, least, most)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(files, "id") if files else rows.repartitionByRange("id")
    rows = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(folder)
        encode, sink, writer, part = encoder(vocabulary).encode, None, None, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for i in range(0, len(batch), BATCH_TEXTS):
                piece = batch.slice(i, BATCH_TEXTS)
                ids, sizes = encode(piece.column("text"))
                if writer is None:
                    part = piece.column("part")[0].as_py()
                    filesystem.create_dir(base, recursive=True)
                    name = f"{base}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                    sink = filesystem.open_output_stream(name, compression=None)
                    writer = FrameWriter(sink)
                at = 0
                for doc_id, size in zip(piece.column("id").to_pylist(), sizes.tolist()):
                    writer.add(doc_id, np.concatenate((ids[at : at + size], end)))
                    at += size
        if writer is not None:
            writer.close()
            sink.close()
            known = [d for d in writer.doc_ids if d is not None]
            yield pa.RecordBatch.from_pydict({
                "file_no": pa.array([part], pa.int32()), "path": [f"{folder}/{name.rsplit('/', 1)[1]}"],
                "n_docs": pa.array([len(writer.sizes)], pa.int64()), "n_ids": pa.array([sum(writer.sizes)], pa.int64()),
                "least": pa.array([min(known, default=None)], pa.int64()), "most": pa.array([max(known, default=None)], pa.int64()),
            })

    schema = "file_no int, path string, n_docs bigint, n_ids bigint, least bigint, most bigint"
    return materialise(rows.mapInArrow(run, schema), "token-manifest")


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, tokens) of all documents, or of those wanted: a list of ids, bounded by the caller.

    ``start`` counts the ids of all documents before it, over all files. Files whose range of ids holds no wanted document
    aren't opened.
    """
    # One row a file; the ids before a file are a running sum over the files.
    upto = Window.partitionBy(F.lit(0)).orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("n_ids").over(upto)
    files = manifest.select("path", "least", "most", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    if wanted is not None:
        files = files.where(" OR ".join(f"{int(w)} BETWEEN least AND most" for w in wanted) or "false")
    chosen = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                filesystem, name = _open(path)
                with filesystem.open_input_file(name) as source:
                    yield from _batches(FrameReader(source).documents(chosen), before)

    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 2, "path").mapInArrow(
        run, "doc_id bigint, start bigint, tokens binary"
    )


def _batches(documents, before: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    doc_ids, starts, tokens, n = [], [], [], 0
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("tokens", pa.binary())])
    for doc_id, start, ids in documents:
        doc_ids.append(doc_id)
        starts.append(before + start)
        tokens.append(ids.tobytes())
        n += len(tokens[-1])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens, pa.binary())], schema=schema)
            doc_ids, starts, tokens, n = [], [], [], 0
    if doc_ids:
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens, pa.binary())], schema=schema)


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id", "start", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")
    )


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes the files to a new folder below the shared one, reads them back and returns the digest of each document."""
    return digest(read_tokens(write_tokens(docs, scratch_path(docs.sparkSession, "token-files"), vocabulary, end_id)))
