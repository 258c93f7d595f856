"""Token-ID files: one independent zstandard frame for each run of ids of one document, then a document index
and a trailing seek table with a checksum of every frame.

File layout, in the published seekable format of zstandard (all numbers little-endian):
  frames            zstandard frames; each holds ids (unsigned 32-bit) of one document only
  document index    a skippable frame (magic 0x184D2A50): count, then per document
                    doc_id i64, null flag u8, frames u32, ids u64
  seek table        a skippable frame (magic 0x184D2A5E): per frame compressed size u32, decompressed size u32,
                    low 32 bits of XXH64 of the decompressed bytes; footer: frames u32, descriptor 0x80, magic 0x8F92EAB1
A reader seeks to the footer, reads both tables and then only the frames of the documents it wants.

Documents are range-partitioned by doc_id, the hash of the text and the place in the input, so neither rows without an
id nor a repeated id make one task long; there are as many partitions as FILE_TEXT_BYTES asks for, the setting of shuffle
partitions at least. Each partition streams one file in ascending doc_id order (ties by the hash of their texts), under
a name of its attempt, and renames it when it is complete, so a task that is run again replaces a file by the same
bytes. Defined results: a null text is empty and has its end id alone; null doc_ids come first; repeated rows are kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch, settle, task
from .encode import default_tokenizer, encoder, text_slices

END_ID = 2
LEVEL = 1
#: Ids of a frame at most; a longer document takes several frames.
FRAME_IDS = 1 << 20
#: Bytes of text that one file is planned for, at most; its tables stay small in the writer and the reader.
FILE_TEXT_BYTES = 512 << 20

_ENTRY, _FOOTER, _DOC = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<qBIQ")
_INDEX_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

FILE_SCHEMA = "part int, path string, first_doc long, docs long, ids long"
READ_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=LEVEL)
        self.entries, self.index, self.ids, self.docs, self.first = bytearray(), bytearray(), 0, 0, None

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frames = range(0, max(len(ids), 1), FRAME_IDS * 4)
        for k in frames:
            part = ids[k : k + FRAME_IDS * 4]
            frame = self.zstd.compress(part)
            self.entries += _ENTRY.pack(len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)
            self.out.write(frame)
        self.index += _DOC.pack(doc_id or 0, doc_id is None, len(frames), len(ids) // 4)
        self.first = doc_id if self.first is None else self.first
        self.ids, self.docs = self.ids + len(ids) // 4, self.docs + 1

    def close(self) -> None:
        index = struct.pack("<I", self.docs) + self.index
        self.out.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        seek = bytes(self.entries) + _FOOTER.pack(len(self.entries) // _ENTRY.size, 0x80, _FOOTER_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_MAGIC, len(seek)) + seek)


class FileReader:
    """Reads the tables at a file's end, then single documents."""

    def __init__(self, source):
        import zstandard

        self.source, size, self.zstd = source, source.size(), zstandard.ZstdDecompressor()
        n, descriptor, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != _FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("not a token-id file: no seek table")
        seek_at = size - _FOOTER.size - n * _ENTRY.size - 8
        self.frames = list(_ENTRY.iter_unpack(self._at(seek_at + 8, n * _ENTRY.size)))
        index_at = sum(f[0] for f in self.frames)
        magic, length = struct.unpack("<II", self._at(index_at, 8))
        if magic != _INDEX_MAGIC:
            raise ValueError("not a token-id file: no document index")
        self.docs, frame, at, start = [], 0, 0, 0
        for doc_id, null, frames, ids in _DOC.iter_unpack(self._at(index_at + 8, length)[4:]):
            self.docs.append((None if null else doc_id, start, ids, at, self.frames[frame : frame + frames]))
            start, at, frame = start + ids, at + sum(f[0] for f in self.frames[frame : frame + frames]), frame + frames

    def _at(self, where: int, n: int) -> bytes:
        self.source.seek(where)
        return self.source.read(n)

    def read(self, doc: tuple) -> bytes:
        """The ids of one entry of docs; raises ValueError where a checksum differs."""
        import xxhash

        raw, at, out = self._at(doc[3], sum(f[0] for f in doc[4])), 0, []
        for packed, size, check in doc[4]:
            part = self.zstd.decompress(raw[at : at + packed], max_output_size=size) if size else b""
            if len(part) != size or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != check:
                raise ValueError(f"checksum of a frame of document {doc[0]} differs")
            out.append(part)
            at += packed
        return b"".join(out)


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, parts: int | None = None, file_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write the files to `folder` (a URI that all executors reach) and return their list (FILE_SCHEMA), already run.
    `parts` files, or where it is not given, as many as `file_bytes` of text each take."""
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text")
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes), 1)
    kinds = pa.schema([("part", pa.int32()), ("path", pa.string()), ("first_doc", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

    @task("encode")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        filesystem, base = _fs(folder)
        final, temporary = f"{base}/part-{part:06d}.tzs", f"{base}/.part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None and batch.num_rows:
                filesystem.create_dir(base, recursive=True)
                out = filesystem.open_output_stream(temporary)
                writer = FileWriter(out)
            doc_ids = batch.column(0).to_pylist()
            for a, b, some in text_slices(batch.column(1)):
                for doc_id, ids in zip(doc_ids[a:b], encoder(path).encode(some), strict=True):
                    writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            out.close()
            filesystem.move(temporary, final)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, f"{folder}/part-{part:06d}.tzs", writer.first, writer.docs, writer.ids), kinds.types, strict=True)], schema=kinds)

    order = [F.col("doc_id").asc_nulls_first(), "mark", "place"]
    placed = rows.withColumns({"mark": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return settle(dealt.mapInArrow(run, FILE_SCHEMA), "token-files")


def read_documents(files: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """One row per document of the listed files (of those in `wanted`), from the ids that the files hold:
    part, doc_id, local_start (ids before it in its file), n_tokens, ids_crc32. Only wanted frames are decompressed."""
    kinds = pa.schema([("part", pa.int32())] + [(n, pa.int64()) for n in ("doc_id", "local_start", "n_tokens", "ids_crc32")])

    @task("encode")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, name = _fs(uri)
                with filesystem.open_input_file(name) as source:
                    reader, rows = FileReader(source), []
                    for doc in reader.docs:
                        if wanted is None or doc[0] in wanted:
                            ids = reader.read(doc)
                            rows.append((part, doc[0], doc[1], len(ids) // 4, zlib.crc32(ids)))
                        if len(rows) >= 20_000 or doc is reader.docs[-1] and rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                            rows = []

    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return files.select("part", "path").repartition(parts, "part").mapInArrow(run, READ_SCHEMA)


def encode_corpus(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32, part.
    The files before each file are summed over the list of files, which has one row per file."""
    files = write_files(docs, folder or scratch(spark, "tokens"), **options)
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = files.select(F.col("part"), before.alias("base"))
    return read_documents(files).join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part")
