"""Media columns: members of archives as rows, through a Spark data source.

``write_archives`` stores each document's bytes as the 8-bit grey samples of a PNG
and puts these into ZIP archives of bounded size in one folder. The data source
``archive`` plans partitions as byte ranges of the folder's archives from their sizes
alone; a task opens an archive's own directory, reads the members whose headers lie
in its range, in batches through Arrow, and retries each member by its offset.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bytetext import chunks
from .scratch import Scratch

WIDTH = 192
PAD = 32
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
RETRIES = 4
COMPRESSION = 6
#: Fixed value: the first bytes of a PNG file.
PNG = b"\x89PNG\r\n\x1a\n"
MEMBER = "archive string, offset long, name string, media binary"
DESCRIBED = "archive string, offset long, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Byte ranges that the driver plans, besides one for each archive.
MAX_RANGES = 100_000


def padded(data: bytes) -> bytes:
    """With bytes 32 up to a positive multiple of WIDTH."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """The padded bytes as samples of a grey image of WIDTH columns; the text chunk n_bytes has the length before."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), np.uint8)
    scan[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), COMPRESSION)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and n_bytes of what ``to_png`` made; checks every chunk."""
    if media[:8] != PNG:
        raise ValueError("not a PNG file")
    at, samples, n_bytes, width = 8, b"", -1, 0
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + length)[0]:
            raise ValueError("a chunk's crc32 differs")
        if kind == b"IHDR":
            (width,) = struct.unpack_from(">I", data)
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n_bytes = int(data[8:])
        elif kind == b"IDAT":
            samples += data
        at += 12 + length
    return np.frombuffer(zlib.decompress(samples), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes(), n_bytes


class _Sink(io.RawIOBase):
    """What zipfile needs of a file that is only written."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.size = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.size += len(data)
        return len(data)


class _Archives:
    """Archives of one task. A finished one gets its name by a move, so a repeated task replaces it whole."""

    def __init__(self, uri: str, task: int, attempt: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(uri)
        self.task, self.attempt, self.number, self.zip = task, attempt, 0, None

    def add(self, name: str, data: bytes) -> None:
        if self.zip is None:
            self.part = f"{self.folder}/_part-{self.task:06d}-{self.number:05d}-{self.attempt}"
            self.sink = _Sink(self.fs.open_output_stream(self.part))
            self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.zip.writestr(zipfile.ZipInfo(name), data)
        if self.sink.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.sink.stream.close()
            self.fs.move(self.part, f"{self.folder}/archive-{self.task:06d}-{self.number:05d}.zip")
            self.zip, self.number = None, self.number + 1


def write_archives(documents: DataFrame, uri: str) -> None:
    """Store every document's text (null: empty) as a PNG member named by its doc_id (null: ``null``)."""
    fs, folder = pafs.FileSystem.from_uri(uri)
    fs.create_dir(folder)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        out = _Archives(uri, context.partitionId(), context.taskAttemptId())
        n = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    out.add("null" if doc_id is None else str(doc_id), to_png((text or "").encode()))
                    n += 1
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    # one row for each task; the count runs them all
    documents.select("doc_id", "text").mapInArrow(store, "n long").agg(F.sum("n")).collect()


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.range_bytes = int(options.get("range_bytes", 0))
        self.retries = int(options.get("retries", RETRIES))
        self.describe = options.get("describe", "false").lower() == "true"

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of each archive by its size; no archive is opened here.

        Ranges grow with the folder, so that the driver plans MAX_RANGES and one for each archive at most.
        """
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".zip"))
        step = self.range_bytes or max(RANGE_BYTES, -(-sum(size for _, size in files) // MAX_RANGES))
        ranges = [ByteRange(path, at, min(at + step, size)) for path, size in files for at in range(0, size, step)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        members = _Members(fs, partition.archive, self.retries)
        rows: list[tuple] = []
        held = 0
        for info in members.directory():
            if partition.start <= info.header_offset < partition.end:
                data = members.read(info)
                row = described(info.filename, data) if self.describe else (info.filename, data)
                rows.append((partition.archive, info.header_offset, *row))
                held += 256 if self.describe else len(data)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        names, types = zip(*(c.split() for c in (DESCRIBED if self.describe else MEMBER).split(", ")), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))


class _Members:
    """Reads members by offset through a block of the archive; each has its own retries."""

    def __init__(self, fs: pafs.FileSystem, path: str, retries: int):
        self.fs, self.path, self.retries = fs, path, retries
        self.file, self.at, self.block = None, 0, b""

    def _again(self, what):
        for attempt in range(self.retries + 1):
            try:
                if self.file is None:
                    self.file, self.block = self.fs.open_input_file(self.path), b""
                return what()
            except (OSError, zipfile.BadZipFile, struct.error) as error:
                self.file = None
                if attempt == self.retries:
                    raise OSError(f"{self.path}: {error}") from error
                time.sleep(0.05 * 2**attempt)

    def directory(self) -> list[zipfile.ZipInfo]:
        return self._again(lambda: zipfile.ZipFile(self.file).infolist())

    def _bytes(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(max(n, BLOCK_BYTES), at)
        return self.block[at - self.at : at - self.at + n]

    def read(self, info: zipfile.ZipInfo) -> bytes:
        def once() -> bytes:
            head = self._bytes(info.header_offset, 30)
            name, extra = struct.unpack_from("<HH", head, 26)
            data = self._bytes(info.header_offset + 30 + name + extra, info.compress_size)
            if head[:4] != b"PK\x03\x04" or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise zipfile.BadZipFile(f"the member at {info.header_offset} is damaged")
            return data

        return self._again(once)


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder)``: a row for each member of each ZIP archive in the folder.

    Members are stored, not compressed. Options: range_bytes (default: 8 MB, more in folders of
    over MAX_RANGES times that), retries, describe (digests and features instead of the media bytes).
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return DESCRIBED if dict(self.options).get("describe", "false").lower() == "true" else MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and the shares of sixteen brightness steps, of the samples as read."""
    level = np.bincount(samples, minlength=256)
    steps = level.reshape(16, 16).sum(1) * 255 // len(samples)
    value = np.arange(256)
    mean, squares = int(level @ value) / len(samples), int(level @ value**2)
    return f"{mean:.4f} {max(0.0, squares / len(samples) - mean * mean) ** 0.5:.4f} {bytes(steps.astype(np.uint8)).hex()}"


def described(name: str, media: bytes) -> tuple:
    """The columns of DESCRIBED after archive and offset, from a member's name and bytes."""
    payload, n_bytes = from_png(media)
    return (None if name == "null" else int(name), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8)))


def media_columns(documents: DataFrame) -> DataFrame:
    """Digests and features of every document's stored media, from archives written and read back.

    Null and empty texts are one row of 192 pad bytes. Repeated rows are members of
    their own; equal texts have equal values but for archive and offset. An empty
    table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "media")
    write_archives(documents, scratch.path("archives"))
    spark.dataSource.register(ArchiveSource)
    # the task that reads a member also describes it: one Python worker, and no payload goes through the JVM
    return spark.read.format("archive").option("describe", "true").load(scratch.path("archives"))
