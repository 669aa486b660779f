"""Data sources for files that Spark's own don't read or write: rows of .npy arrays, and one text file a document.

Files are opened by Arrow's file systems, so paths may be local, hdfs:// or s3://.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of an array that one task reads, and that one batch of it holds.
RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", uri))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Rows(InputPartition):
    """Rows first to last (without it) of an array file, whose data begin at offset."""

    path: str
    kind: str
    offset: int
    width: int
    first: int
    last: int


class NpyRows(DataSource):
    """(file, row, values): the rows of the .npy files of a folder, or of one file; a task reads a range of rows. Arrays of one dimension have rows of one value; others than of one or two, Fortran-ordered ones and such of objects are refused."""

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "file string, row bigint, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Rows]:
        system, path = opened(self.path)
        at = system.get_file_info(path)
        files = [at] if at.is_file else [x for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and x.path.endswith(".npy")]
        return [part for x in sorted(files, key=lambda x: x.path) for part in self.ranges(system, x.path)] or [Rows("", "<f8", 0, 0, 0, 0)]

    def ranges(self, system: fs.FileSystem, path: str) -> Iterator[Rows]:
        with system.open_input_file(path) as file:
            version = np.lib.format.read_magic(file)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
            offset = file.tell()
        if len(shape) not in (1, 2) or fortran or kind.kind not in "fiub":
            raise ValueError(f"{path} has no rows of numbers: shape {shape}, type {kind}, Fortran order {fortran}")
        width = shape[1] if len(shape) == 2 else 1
        step = max(1, self.range_bytes // max(1, width * kind.itemsize))
        for first in range(0, shape[0], step):
            yield Rows(path, kind.str, offset, width, first, min(shape[0], first + step))

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        kind, name = np.dtype(part.kind), part.path.rsplit("/", 1)[-1]
        step = max(1, BATCH_BYTES // max(1, part.width * 8))
        with opened(self.path)[0].open_input_file(part.path) as file:
            file.seek(part.offset + part.first * part.width * kind.itemsize)
            for first in range(part.first, part.last, step):
                n = min(step, part.last - first)
                data = file.read(n * part.width * kind.itemsize)
                if len(data) < n * part.width * kind.itemsize:
                    raise ValueError(f"{part.path} ends before row {part.last}")
                values = pa.array(np.frombuffer(data, kind).astype(np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), values)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(first, first + n)), lists], names=["file", "row", "values"])


@dataclass
class Written(WriterCommitMessage):
    """Where a task's files are."""

    partition: int
    folder: str


class DocumentFiles(DataSource):
    """Writes rows of (name, value) as lines of the files name.txt. The rows of a name must be one run of one partition. Readers of text files find them in folders part=<batch>-<number>, which add a column part. A batch that has been written already is left as it is, so a rerun adds nothing; a batch that failed leaves nothing that readers see."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("document_files only adds batches; write with mode append")
        return FilesWriter(self.options["path"], self.options.get("batch", "all"))


class FilesWriter(DataSourceWriter):
    """Tasks write into a folder of their attempt; the commit moves the folders of those that count, one move a task."""

    def __init__(self, path: str, batch: str) -> None:
        self.path, self.batch = path.rstrip("/"), quote(batch, safe="")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        task = TaskContext.get()
        system, folder = opened(f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}")
        done: str | None = None
        for name, lines in itertools.groupby(rows, key=lambda row: row[0]):
            if name is None or (done is not None and str(name) <= done):
                raise ValueError("a file needs a name, and its lines must come in one run, by rising names")
            if done is None:
                system.create_dir(folder)
            done = str(name)
            with system.open_output_stream(f"{folder}/{quote(done, safe=' ')}.txt") as file:
                for row in lines:
                    file.write(f"{'' if row[1] is None else row[1]}\n".encode())
        return Written(task.partitionId(), folder if done is not None else "")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        marker = f"{root}/_batches/{self.batch}"
        if system.get_file_info(marker).type == fs.FileType.NotFound:
            system.create_dir(f"{root}/_batches")
            for found in system.get_file_info(fs.FileSelector(root)):  # of a commit that was broken off
                if re.fullmatch(rf"part={re.escape(self.batch)}-\d+", found.base_name):
                    system.delete_dir(found.path)
            for message in messages:
                if message is not None and message.folder:
                    system.move(message.folder, f"{root}/part={self.batch}-{message.partition}")
            with system.open_output_stream(marker) as file:
                file.write(b"")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, staging = opened(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


def register(spark: SparkSession) -> None:
    """Makes the formats npy_rows and document_files known to the session."""
    for source in (NpyRows, DocumentFiles):
        spark.dataSource.register(source)


def picture_size(file: pa.NativeFile) -> tuple[int, int] | None:
    """Width and height in the head of a PNG or JPEG file; None for others and for broken ones. Only markers are read, segments are stepped over."""
    number = lambda size: int.from_bytes(file.read(size), "big")
    head = file.read(8)
    if head == b"\x89PNG\r\n\x1a\n":
        file.seek(16)
        size = number(4), number(4)
        return size if all(size) else None
    if head[:2] != b"\xff\xd8":
        return None
    at, end = 2, file.size()
    while at + 9 <= end:
        file.seek(at)
        if number(1) != 0xFF:
            return None
        marker = number(1)
        if marker == 0xFF:  # filling before a marker
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # without a segment
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            file.seek(at + 5)
            height, width = number(2), number(2)
            return (width, height) if width and height else None
        elif marker in (0xD9, 0xDA):
            return None
        else:
            at += 2 + max(2, number(2))
    return None


def picture_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, width, height of batches of paths."""
    for batch in batches:
        sizes = []
        for uri in batch.column("path").to_pylist():
            system, path = opened(uri)
            with system.open_input_file(path) as file:
                sizes.append(picture_size(file) or (None, None))
        width, height = (pa.array([x[k] for x in sizes], pa.int32()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("path"), width, height], names=["path", "width", "height"])
