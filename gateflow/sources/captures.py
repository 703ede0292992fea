"""Captures of any size as a data source: byte ranges of files that find their own packets, and files that grow as a stream.

A packet is an image, the mark, and a header. The first mark after a packet's end is the next packet's, so framing runs from the start of a file; but a mark
inside a header (which any bytes may make) is none. A range that begins in the middle looks back for a stretch as long as a mark and
a header without any mark in it: no header can reach over it, so the next mark is one, and framing goes on from there. A packet
belongs to the range in which its header ends."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .packets import CROP, CROP_DDL, FLUSH_BYTES, FLUSH_ROWS, MARK, SNAPSHOT, SNAPSHOT_DDL, packet_fields

_MARK = re.compile(re.escape(MARK))
#: Bytes that a range looks back at first, and that it reads at a time.
LOOK_BACK, READ_BYTES = 1 << 16, 1 << 20


def _ddl(kind: str) -> str:
    """The columns of the decoders, with the byte ``offset`` at which the packet begins in place of its number."""
    return (CROP_DDL if kind == "crop" else SNAPSHOT_DDL).replace("pos int", "offset bigint")


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "decimal(20,0)": pa.decimal128(20, 0)}


def _arrow(kind: str) -> pa.Schema:
    """The columns' Arrow types. A source's worker has no session that could read the DDL."""
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in _ddl(kind).split(", ")])


class Bytes:
    """A file read by place, in pieces that are kept until they are behind."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        self.low, self.held = 0, b""

    def read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(end - start)

    def find_mark(self, at: int, end: int) -> int:
        """Place of the first mark at ``at`` or after that ends by ``end``, or -1."""
        if not self.low <= at <= self.low + len(self.held):
            self.low, self.held = at, b""
        self.held, self.low = self.held[at - self.low :], at
        seen = 0
        while True:
            found = self.held.find(MARK, seen)
            if found >= 0:
                return self.low + found if self.low + found + len(MARK) <= end else -1
            seen = max(0, len(self.held) - len(MARK) + 1)
            top = self.low + len(self.held)
            more = self.read(top, min(end, top + READ_BYTES)) if top < end else b""
            if not more:
                return -1
            self.held += more

    def cut(self, start: int, end: int) -> bytes:
        if self.low <= start and end <= self.low + len(self.held):
            return self.held[start - self.low : end - self.low]
        return self.read(start, end)


def packet_end_before(data: Bytes, at: int, header: int) -> int:
    """The end of the last packet that ends at ``at`` or before (0 is one)."""
    span = LOOK_BACK
    while True:
        low = max(0, at - span)
        text = data.read(low, at)
        marks = [low + m.start() for m in re.finditer(b"(?=" + re.escape(MARK) + b")", text)]
        if low == 0:
            first = 0
        else:
            # the first stretch of a mark and a header without a mark that begins in it
            quiet, first = low, None
            for m in [*marks, at]:
                if m - quiet >= len(MARK) + header:
                    first = quiet + len(MARK) + header
                    break
                quiet = m + 1
        end = None
        if first is not None:
            true, end = first, 0 if low == 0 else None
            for m in marks:
                if m >= true and m + len(MARK) + header <= at:
                    true = end = m + len(MARK) + header
        if end is not None:
            return end
        span *= 4


def range_packets(data: Bytes, start: int, end: int, layout: struct.Struct):
    """(offset, image, header fields) of the packets whose header ends after ``start`` and by ``end``."""
    at = packet_end_before(data, start, layout.size) if start else 0
    while (mark := data.find_mark(at, end)) >= 0:
        last = mark + len(MARK) + layout.size
        if last > end:
            return
        if last > start:
            yield at, data.cut(at, mark), layout.unpack(data.cut(mark + len(MARK), last))
        at = last


@dataclass
class Range:
    uri: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    parts: list[Range]


def packed(ranges: list[Range], size: int) -> list[Ranges]:
    """Ranges dealt to tasks in order, each until it has ``size`` bytes: many small files are one task's work."""
    out, held = [], size
    for r in ranges:
        if held >= size:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(r)
        held += r.end - r.start
    return out


def _files(path: str) -> tuple[fs.FileSystem, dict[str, int]]:
    """Files under a folder, or the one file, with their sizes."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, {f.path: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}


def _rows(options: dict, task: Ranges):
    kind, schema = options["kind"], _arrow(options["kind"])
    system, _ = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), "")
    rows, size = [], 0

    def emit():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for part in task.parts:
        for offset, image, header in range_packets(Bytes(system, part.uri), part.start, part.end, CROP if kind == "crop" else SNAPSHOT):
            rows.append((part.uri, offset, *packet_fields(kind, header, image)))
            size += len(image)
            if size >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                yield emit()
                rows, size = [], 0
    if rows:
        yield emit()


def _ranges(sizes: dict[str, int], starts: dict[str, int], width: int) -> list[Range]:
    return [Range(p, at, min(at + width, end)) for p, end in sorted(sizes.items()) for at in range(starts.get(p, 0), end, width)]


class CaptureSource(DataSource):
    """``spark.read.format("capture")``, or ``readStream``, with the options ``path`` (a folder or file), ``kind`` (``crop`` or ``snapshot``)
    ``range_bytes``, and ``task_bytes``, up to which ranges are read by one task. Bytes after a file's last whole packet are no row; a stream reads them when the file has grown."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def _options(self) -> dict:
        return {"path": self.options["path"], "kind": self.options.get("kind", "crop"), "range_bytes": int(self.options.get("range_bytes", 64 << 20)), "task_bytes": int(self.options.get("task_bytes", 64 << 20))}

    def schema(self) -> str:
        return _ddl(self._options()["kind"])

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStream(self._options())


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Ranges]:
        return packed(_ranges(_files(self.options["path"])[1], {}, self.options["range_bytes"]), self.options["task_bytes"])

    def read(self, partition: Ranges):
        return _rows(self.options, partition)


class CaptureStream(DataSourceStreamReader):
    """Offsets are the sizes of the files. A packet is told when its header has come."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _files(self.options["path"])[1]

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return packed(_ranges(end, start, self.options["range_bytes"]), self.options["task_bytes"])

    def read(self, partition: Ranges):
        return _rows(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


def read_captures(spark: SparkSession, path: str, kind: str = "crop", range_bytes: int = 64 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Rows of the captures under ``path``, which must be in a file system that Arrow reads (local, HDFS, S3, GCS); for others there is
    :func:`.packets.read_crop_packets`, whose captures are one value each."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").options(path=path, kind=kind, range_bytes=range_bytes, task_bytes=task_bytes).load()


def stream_captures(spark: SparkSession, path: str, kind: str = "crop", range_bytes: int = 64 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The packets of captures that grow, as they come."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").options(path=path, kind=kind, range_bytes=range_bytes, task_bytes=task_bytes).load()


def write_captures(captures: DataFrame, folder: str) -> DataFrame:
    """Write captures (path, content) as files under ``folder``, each by its task; (path, bytes written)."""
    remote = "://" in folder or folder.startswith("file:")

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder) if remote else (fs.LocalFileSystem(), folder)
        made = set()
        for batch in batches:
            names, sizes = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                parent = f"{root}/{path}".rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{root}/{path}") as out:
                    out.write(content.as_buffer())
                names.append(path), sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return captures.select("path", "content").where("content is not null").mapInArrow(run, "path string, size long")
