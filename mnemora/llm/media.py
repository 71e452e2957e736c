"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a grey PNG of 8-bit samples, 64 to a row, under its SHA-256 as an ordinary tar
member. Each task writes shards of its own in the shared folder and stores a payload once however many
of its rows hold it; the rows carry digest, shard, offset and length. `addresses` names one place for
every digest over all shards, which is the one that is read. Metadata columns are read by ranges of HEADER_BYTES at
the members' offsets; payloads by ranges of the members' lengths. Reading tasks are dealt by stored bytes.

Shards of a lost attempt are named by no row: the rows are written as a table right after the shards.

Defined cases: a null or empty text is 64 zero bytes; texts of any length are one member; repeated rows
share a member; a null doc_id is kept; columns other than doc_id and text, whatever their names, are ignored; an empty
table writes no shard and gives no rows."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, written

WIDTH = 64
HEADER_BYTES = 33
SHARD_BYTES = 1 << 28
#: Stored bytes that a task reads.
SLICE_BYTES = 8 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """payload (a positive multiple of WIDTH bytes) as a grey 8-bit PNG."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)
    lines[:, 1:] = samples
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER_BYTES of a stored payload."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    width, height, _ = read_header(media[:HEADER_BYTES])
    at, data = 8, b""
    while at < len(media):
        n, kind = struct.unpack(">I", media[at : at + 4])[0], media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Column average hash, mean and deviation of the samples."""
    s = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = s.sum(axis=0, dtype=np.int64)
    bits = np.packbits(columns * WIDTH > columns.sum())
    return f"{bits.tobytes().hex()}:{s.mean():.3f}:{s.std():.3f}"


class ShardWriter:
    def __init__(self, folder: str):
        self.fs, self.path = filesystem(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.out, self.name, self.at = None, "", 0

    def add(self, digest: str, media: bytes) -> tuple[str, int, int]:
        """(shard, offset, length) of the new member's content."""
        if self.out is not None and self.at > SHARD_BYTES:
            self.close()
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        place = self.at + len(head)
        self.out.write(head + media + bytes(-len(media) % 512))
        self.at = place + len(media) + -len(media) % 512
        return self.name, place, len(media)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length: the written table over the shards in folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = ShardWriter(folder), {}
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                payload = padded(raw)
                key = hashlib.sha256(payload).digest()
                if key not in seen:
                    seen[key] = shards.add(key.hex(), encode_png(payload))
                for c, v in zip(cols, (len(raw), key.hex(), *seen[key])):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), spark, "media-rows")


def addresses(rows: DataFrame) -> DataFrame:
    """digest -> one (shard, offset, length) and the number of rows, over all shards."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"), F.count("*").alias("rows")).select("digest", "place.*", "rows")


def _ranges(rows: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """rows in order of their places, as many tasks as their payloads have slices of slice_bytes."""
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return rows.repartitionByRange(max(1, -(-int(total) // slice_bytes)), "shard", "offset").sortWithinPartitions("shard", "offset")


def _opened(folder: str):
    fs, path = filesystem(folder)
    name, file = None, None

    def read(shard: str, offset: int, length: int) -> bytes:
        nonlocal name, file
        if shard != name:
            if file is not None:
                file.close()
            name, file = shard, fs.open_input_file(f"{path}/{shard}")
        return file.read_at(length, offset)

    return read


def header_columns(rows: DataFrame, folder: str) -> DataFrame:
    """rows with width, height and bits, from HEADER_BYTES a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _opened(folder)
        for b in batches:
            heads = [read_header(read(s, o, HEADER_BYTES)) for s, o in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist())]
            extra = [pa.array([h[i] for h in heads], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "width", "height", "bits"])

    return _ranges(rows).mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, width int, height int, bits int")


def read_payloads(places: DataFrame, folder: str) -> DataFrame:
    """digest with what the bytes stored at one place of it say: sizes, digests, feature, header columns. A payload is
    read once, however many rows hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _opened(folder)
        for b in batches:
            out: list[tuple] = []
            for s, o, n, d in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "digest"))):
                width, height, _ = read_header(read(s, o, HEADER_BYTES))
                media = read(s, o, n)
                payload = decode_png(media)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != d or len(payload) != width * height:
                    raise ValueError(f"{s}:{o} does not hold {d}")
                out.append((d, len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), width, height))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_width", "media_height"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return _ranges(places.select("digest", "shard", "offset", "length")).mapInArrow(
        run,
        "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_width int, media_height int",
    )


def read_back(rows: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes and what read_payloads finds for the row's digest."""
    return rows.select("doc_id", "n_bytes", "digest").join(read_payloads(addresses(rows), folder), "digest").drop("digest")


def media_columns(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """store, then read_back."""
    folder = shared_dir(spark, "media")
    return read_back(store(docs, spark, folder), folder)
