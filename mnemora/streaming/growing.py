"""A stream of the lines of files that grow: a Python data source whose offsets are bytes of files.

A batch takes the lines that end in a newline; what is torn waits for the rest. Every offset remembers each file's bytes
taken and digests of its first and of its last bytes taken, so a file that was replaced, rewritten or shortened, or that is
gone, is an error when the next batch is planned, after a restart as well. The work is dealt in ranges of bytes. An offset
holds a line for each file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a digest, of a look for the last newline, and of a range that one task reads.
HEAD, STEP, RANGE = 4096, 64 << 10, 32 << 20


class Part(NamedTuple):
    path: str
    begin: int
    start: int
    stop: int


class Range(InputPartition):
    def __init__(self, part: Part):
        self.part = tuple(part)


def _opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
    return system, at


def _files(folder: str) -> dict[str, int]:
    """Path and size of a file, or of a folder's files, but hidden ones."""
    from pyarrow import fs

    system, at = _opened(folder)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return {}
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=False))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.bytes, self.most = options["path"], int(options.get("range", RANGE)), int(options.get("mostfiles", 0))
        self.system = None

    def _read(self, path: str, start: int, stop: int) -> bytes:
        system, _ = _opened(self.folder)
        with system.open_input_file(path) as f:
            return f.read_at(stop - start, start)

    def _digest(self, path: str, start: int, stop: int) -> str:
        return hashlib.sha256(self._read(path, start, stop)).hexdigest()

    def _mark(self, path: str, taken: int) -> dict:
        return {"bytes": taken, "head": self._digest(path, 0, min(HEAD, taken)), "tail": self._digest(path, max(0, taken - HEAD), taken)}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        sizes = _files(self.folder)
        if self.most and len(sizes) > self.most:
            raise ValueError(f"{self.folder} has {len(sizes)} files, more than {self.most}")
        return {path: self._mark(path, self._whole(path, size)) for path, size in sorted(sizes.items())}

    def _whole(self, path: str, size: int) -> int:
        """Bytes up to the last newline."""
        stop = size
        while stop > 0:
            start = max(0, stop - STEP)
            at = self._read(path, start, stop).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Ranges of the new bytes; an error where the old ones aren't what they were."""
        found, sizes = [], _files(self.folder)
        for path, was in start.items():
            if path not in sizes:
                raise ValueError(f"{path} is gone")
            if sizes[path] < was["bytes"]:
                raise ValueError(f"{path} was shortened")
            if self._mark(path, was["bytes"]) != was:
                raise ValueError(f"{path} was replaced")
        for path, now in end.items():
            begin = start.get(path, {"bytes": 0})["bytes"]
            found += [Range(Part(path, begin, a, min(a + self.bytes, now["bytes"]))) for a in range(begin, now["bytes"], self.bytes)]
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range, with the byte they begin at."""
        path, begin, start, stop = partition.part
        system, _ = _opened(self.folder)
        with system.open_input_file(path) as f:
            # the line that is open at start, or ends before it, is another range's
            at, held, whole = max(begin, start - 1), b"", start == begin
            while at < stop:
                more = f.read_at(STEP, at + len(held))
                held += more
                cut = held.rfind(b"\n") + 1
                if not cut and not more:
                    return
                if not cut:
                    continue
                lines, kept, places = held[:cut].split(b"\n")[:-1], [], []
                for line in lines:
                    if whole and at < stop:
                        kept.append(line.removesuffix(b"\r").decode())
                        places.append(at)
                    whole = True
                    at += len(line) + 1
                held = held[cut:]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept)), pa.array(places, pa.int64()), pa.array(kept)], names=["file", "at", "value"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Option path: a file or a folder, as a URI that all executors reach; range: bytes of a task; mostfiles: more files are an error."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def growing_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, at (the byte it begins at) and value of each line of the files at path, as they grow."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
