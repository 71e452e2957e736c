"""Token files of independent zstandard frames with a trailing seek table.

A file holds one frame per document, each with the format's own content checksum: the document's ids as
little-endian unsigned 32-bit numbers. Then come two skippable frames: the documents' ids (8 bytes each, then
one bit each for "no id"; magic 0x184D2A50) and the seek table of the public zstd seekable format (magic 0x184D2A5E: per frame its
compressed size, its size and the low 32 bits of the XXH64 of its content; then the number of frames, a
descriptor byte with the checksum flag, and 0x8F92EAB1). A reader takes the tail of a file, looks up the
frames of the documents asked for, and reads and decompresses no others.

Files hold ascending ranges of (doc_id, text hash, place in the input); ascending file names continue each
other. Equal rows may lie in several ranges, so no id or text has to fit in one task. Tasks
write under a name of their own attempt and then report it, so a lost task leaves at most an unnamed
file. The driver gathers one row per file (its name, documents and tokens), never one per document.

Defined cases: a null or empty text is the end id alone; equal doc_ids are ordered by the text's hash;
a null doc_id sorts first and comes back as null (the least 64-bit number stays itself); a very long text is one
frame, like any other; columns other than doc_id and text, whatever their names, are ignored; an empty table makes
no file."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_dir
from .tokenize import byte_encoder

SEEK_MAGIC, IDS_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
NULL_ID = -(1 << 63)


class Writer:
    """Appends documents to one file."""

    def __init__(self, out, level: int = 1):
        import zstandard

        self.out, self.seek, self.ids = out, [], []
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.seek.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        absent = np.array([i is None for i in self.ids], bool)
        ids = np.array([NULL_ID if i is None else i for i in self.ids], "<i8").tobytes() + np.packbits(absent).tobytes()
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids + struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to one file's documents."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        at = size - 9 - 12 * n
        table = np.frombuffer(self.file.read_at(12 * n, at), "<u4").reshape(n, 3)
        self.sizes, self.sums = table[:, 1].astype(np.int64), table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        raw = self.file.read_at(8 * n + -(-n // 8), at - 8 - 8 * n - -(-n // 8))
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.absent = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * n), count=n).astype(bool)
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def decoded(self, i: int, frame: bytes) -> bytes:
        import xxhash

        ids = self.decompressor.decompress(frame) if self.sizes[i] else b""
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != int(self.sums[i]) or len(ids) != self.sizes[i]:
            raise ValueError(f"frame {i} is damaged")
        return ids

    def read(self, i: int) -> bytes:
        """The ids of the i-th document; no other frame is read."""
        return self.decoded(i, self.file.read_at(int(self.starts[i + 1] - self.starts[i]), int(self.starts[i])))

    def find(self, doc_id: int) -> list[int]:
        """Frames of a document, by binary search over the sorted ids."""
        a, b = np.searchsorted(self.doc_ids, doc_id, "left"), np.searchsorted(self.doc_ids, doc_id, "right")
        return [i for i in range(a, b) if not self.absent[i]]

    def scan(self, block: int = 1 << 22) -> Iterator[tuple[int | None, bytes]]:
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + block, "right")) - 1)
            j = min(j, len(self))
            raw = self.file.read_at(int(self.starts[j] - self.starts[i]), int(self.starts[i]))
            for k in range(i, j):
                yield None if self.absent[k] else int(self.doc_ids[k]), self.decoded(k, raw[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]])
            i = j


def write_tokens(docs: DataFrame, spark: SparkSession, tokenizer: str, end_id: int = 0, folder: str | None = None) -> list[tuple[str, int, int]]:
    """Writes (doc_id, text) and returns (file, documents before it, ids before it) per file, ascending."""
    folder = folder or shared_dir(spark, "tokens")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, tokens = byte_encoder(tokenizer), None, 0
        for b in batches:
            if writer is None and b.num_rows:
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens.zst"
                fs, path = filesystem(folder)
                fs.create_dir(path, recursive=True)
                writer = Writer(fs.open_output_stream(f"{path}/{name}", compression=None))
            ids, at = encoder.encode_batch(b.column(1))
            raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), (at * 4).tolist()
            for doc_id, x, y in zip(b.column(0).to_pylist(), at[:-1], at[1:]):
                writer.add(doc_id, bytes(raw[x:y]) + end)
            tokens += len(ids) + b.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(writer.ids)]), pa.array([tokens])], names=["file", "docs", "tokens"])

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    rows = (
        dealt.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place").select("doc_id", "text")
        .mapInArrow(run, "file string, docs long, tokens long").collect()
    )
    out, n, t = [], 0, 0
    for r in sorted(rows, key=lambda r: r["file"]):
        out.append((f"{folder}/{r['file']}", n, t))
        n, t = n + r["docs"], t + r["tokens"]
    return out


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files, a task per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader, rows = Reader(uri), []
                for doc_id, ids in reader.scan():
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame([(f, t) for f, _, t in files], "file string, start long")
    return names.repartitionByRange(max(1, len(files)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
