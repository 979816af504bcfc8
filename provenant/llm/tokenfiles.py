"""Token ids as files of independent zstandard frames with a seek table at the end.

Layout of one file: a frame per document, holding its ids as little-endian unsigned 32-bit integers;
a skippable frame with the document ids; a seek table in the zstandard seekable format, with the
compressed and uncompressed size of every frame and the low 32 bits of the XXH64 of its content. A
reader takes the table from the end of the file and then decompresses only the frames of the
documents it was asked for, each checked against its checksum.

Files follow ascending document id over the whole corpus: documents are range-partitioned by id and
each task writes one file. A task that is run again writes a file of another name, and only
the files named in the manifest, which holds what successful tasks returned, are ever read.

Defined results: null text counts as empty; a null id comes first; rows with one id keep
their order by text, and each is a document of its own. Other columns are ignored. An empty table gives
an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.llm.bytepieces import encoder

SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
MANIFEST = "part int, file string, n_docs long, n_tokens long, n_bytes long"
#: Seek-table sizes are 32-bit; a longer document is refused rather than cut.
MOST_BYTES = 2**32 - 1


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        pa.fs.LocalFileSystem(), folder)


class FrameWriter:
    """Writes one file; documents must come in their final order."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def put(self, doc_id: int | None, content: bytes) -> None:
        if len(content) > MOST_BYTES:
            raise ValueError(f"document {doc_id}: {len(content)} bytes do not fit one frame")
        frame = self.compressor.compress(content)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.sink.write(frame)

    def close(self) -> None:
        ids = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()
        known = np.array([i is not None for i in self.ids], np.uint8).tobytes()
        index = struct.pack("<II", SKIPPABLE, len(ids) + len(known)) + ids + known
        self.entries.append((len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        footer = FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.sink.write(index + struct.pack("<II", SEEK_TABLE, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Reads single documents of one file, given as an object with seek, read and size."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - FOOTER.size)
        count, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        start = end - FOOTER.size - count * ENTRY.size
        source.seek(start)
        table = np.frombuffer(source.read(count * ENTRY.size), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.sizes, self.checksums = table[:-1, 1], table[:-1, 2]
        source.seek(int(self.offsets[-2]) + 8)
        index = source.read(int(table[-1, 0]) - 8)
        n = count - 1
        ids, known = np.frombuffer(index[: 8 * n], "<i8"), np.frombuffer(index[8 * n :], np.uint8)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.decompressor = zstandard.ZstdDecompressor()

    def content(self, k: int) -> bytes:
        """The bytes of document number k of the file."""
        self.source.seek(int(self.offsets[k]))
        frame = self.source.read(int(self.offsets[k + 1] - self.offsets[k]))
        content = self.decompressor.decompress(frame, max_output_size=int(self.sizes[k]) or 1)
        if len(content) != self.sizes[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} is damaged")
        return content


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text", level: int = 3) -> DataFrame:
    """Encode and write all documents below ``folder``; returns the manifest, stored there too."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sink, writer, tokens, part = encoder(tokenizer), None, None, 0, TaskContext.get().partitionId()
        files, base = _filesystem(folder)
        name = f"tokens-{part:07d}-{uuid.uuid4().hex}.zst"
        for frame in frames:
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    sink = files.open_output_stream(f"{base}/{name}", compression=None)
                    writer = FrameWriter(sink, level)
                ids = np.append(made.encode(text), end_id).astype("<u4")
                tokens += len(ids)
                writer.put(doc_id, ids.tobytes())
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "n_docs": len(writer.ids), "n_tokens": tokens, "n_bytes": size}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                           ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    spark = docs.sparkSession
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(
        F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("text"))
    ordered.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _with_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each file. The manifest has one row per file, so one task may order it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def scan(spark: SparkSession, folder: str, wanted: Iterable[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the files; ``wanted`` names the documents to decompress."""
    chosen = None if wanted is None else frozenset(wanted)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        for frame in frames:
            for row in frame.to_pylist():
                with files.open_input_file(f"{base}/{row['file']}") as source:
                    reader, rows, held = FrameReader(source), [], 0
                    counts = reader.sizes // 4
                    starts = row["before"] + np.cumsum(counts) - counts
                    for k, doc_id in enumerate(reader.doc_ids):
                        if chosen is None or doc_id in chosen:
                            rows.append((doc_id, int(starts[k]), int(counts[k]), content := reader.content(k)))
                            held += len(content)
                        if held > 8_000_000:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # A given number of partitions, which Spark does not merge again however few bytes the manifest has.
    return _with_starts(manifest).repartition(min(10_000, max(1, manifest.count()))).mapInArrow(
        task, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def checks(found: DataFrame) -> DataFrame:
    """The CRC-32 of each document's ids as they lie in the file."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
