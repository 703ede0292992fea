"""Captures of binary packets: an image, ``END!``, then a header that describes the image before it."""

from __future__ import annotations

import re
import struct
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MARK = b"END!"
# Wire layouts, little-endian.
CROP = struct.Struct("<IIIQ5fIQI")
SNAPSHOT = struct.Struct("<II16s4fQI")
CROP_DDL = "path string, pos int, device_id int, source_id int, class_id int, object_id decimal(20,0), confidence double, bbox_left double, bbox_top double, bbox_width double, bbox_height double, frame_num bigint, ts_ms decimal(20,0), size bigint, ok boolean, image binary"
SNAPSHOT_DDL = "path string, pos int, device_id int, source_id int, kind string, bbox_left double, bbox_top double, bbox_width double, bbox_height double, ts_ms decimal(20,0), size bigint, ok boolean, image binary"


_MARK = re.compile(re.escape(MARK))


def split_packets(data: bytes | memoryview, layout: struct.Struct):
    """(image, header fields) of each complete packet; framing is by the first mark."""
    at = 0
    while (mark := _MARK.search(data, at)) and mark.end() + layout.size <= len(data):
        yield bytes(data[at : mark.start()]), layout.unpack_from(data, mark.end())
        at = mark.end() + layout.size


def _signed(device: int) -> int:
    """A 32-bit field as an int: what a header cannot mean is negative, and no error."""
    return device - (1 << 32) if device >= 1 << 31 else device


def packet_fields(kind: str, header: tuple, image: bytes) -> tuple:
    """The columns that a header gives, with the image that it describes."""
    if kind == "crop":
        device, source, cls, obj, conf, *box, frame, ts, size = header
        return (_signed(device), _signed(source), _signed(cls), Decimal(obj), conf, *box, frame, Decimal(ts), size, size == len(image), image)
    device, source, name, *box, ts, size = header
    return (_signed(device), _signed(source), name.split(b"\0")[0].decode("ascii", "replace"), *box, Decimal(ts), size, size == len(image), image)


def packet_rows(kind: str, path: str, data: bytes):
    """Rows of one capture, as in the layout's schema."""
    for pos, (image, header) in enumerate(split_packets(data, CROP if kind == "crop" else SNAPSHOT)):
        yield (path, pos, *packet_fields(kind, header, image))


#: Bytes of images, and packets or captures, that leave a task at a time.
FLUSH_BYTES, FLUSH_ROWS = 8 << 20, 1 << 13


def _decode(kind: str, schema: pa.Schema):
    """Rows of captures, a few images at a time."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                if not data.is_valid:
                    continue
                for row in packet_rows(kind, path.as_py(), memoryview(data.as_buffer())):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                        yield emit(rows)
                        rows, size = [], 0
            if rows:
                yield emit(rows)

    return run


def _decoded(files: DataFrame, kind: str, ddl: str) -> DataFrame:
    schema = StructType.fromDDL(ddl)
    return files.select("path", "content").mapInArrow(_decode(kind, to_arrow_schema(schema)), schema)


def decode_crop_packets(files: DataFrame) -> DataFrame:
    """Rows of captures (path, content); one whose size does not match its image has ``ok`` false. A null content has none."""
    return _decoded(files, "crop", CROP_DDL)


def decode_snapshot_packets(files: DataFrame) -> DataFrame:
    return _decoded(files, "snapshot", SNAPSHOT_DDL)


def _table_function(kind: str, ddl: str):
    """A table function of a capture's content: a row a packet, told one by one. (An Arrow table function cannot stand in a lateral join.)"""

    class DecodePackets:
        def eval(self, content: bytes):
            if content is not None:
                for _, *row in packet_rows(kind, "", content):
                    yield tuple(row)

    return F.udtf(DecodePackets, returnType=StructType([c for c in StructType.fromDDL(ddl).fields if c.name != "path"]))


def register_table_functions(spark: SparkSession) -> None:
    """``decode_packets(content)`` and ``decode_snapshots(content)`` for SQL: ``FROM files, LATERAL decode_packets(content)``."""
    spark.udtf.register("decode_packets", _table_function("crop", CROP_DDL))
    spark.udtf.register("decode_snapshots", _table_function("snapshot", SNAPSHOT_DDL))


_FIELDS = {
    "crop": ("device_id", "source_id", "class_id", "object_id", "confidence", "bbox_left", "bbox_top", "bbox_width", "bbox_height", "frame_num", "ts_ms", "size"),
    "snapshot": ("device_id", "source_id", "kind", "bbox_left", "bbox_top", "bbox_width", "bbox_height", "ts_ms", "size"),
}


def _layout(kind: str) -> struct.Struct:
    return CROP if kind == "crop" else SNAPSHOT


def _pack(kind: str):
    """Captures of rows whose paths stand together, in order of ``pos``; one capture is held at a time."""

    def emit(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.binary())], ["path", "content"])

    def run(batches):
        layout = _layout(kind)
        at, out, done, size = None, None, [], 0
        for batch in batches:
            fields = zip(*(batch.column(c).to_pylist() for c in _FIELDS[kind]), strict=True)
            for path, image, (device, *rest) in zip(batch.column("path").to_pylist(), batch.column("image").to_pylist(), fields, strict=True):
                if out is None or path != at:
                    if out is not None:
                        done.append((at, bytes(out)))
                        size += len(out)
                        if size >= FLUSH_BYTES or len(done) >= FLUSH_ROWS:
                            yield emit(done)
                            done, size = [], 0
                    at, out = path, bytearray()
                out += image + MARK + layout.pack(device & 0xFFFFFFFF, *(x.encode() if isinstance(x, str) else x for x in rest))
        if out is not None:
            yield emit([*done, (at, bytes(out))])

    return run


def encode_packets(rows: DataFrame, kind: str) -> DataFrame:
    """Captures (path, content) of rows (path, pos, the fields of the layout, image), packed in order of ``pos``: the way back of the
    decoders. A path is one capture, and so one task's work; a task packs its paths one after the other."""
    named = rows.select("path", "pos", *_FIELDS[kind], "image").repartition("path")
    return named.sortWithinPartitions("path", F.col("pos").asc_nulls_last()).mapInArrow(_pack(kind), "path string, content binary")


def read_crop_packets(spark: SparkSession, path: str) -> DataFrame:
    return decode_crop_packets(spark.read.format("binaryFile").load(path))


def read_snapshot_packets(spark: SparkSession, path: str) -> DataFrame:
    return decode_snapshot_packets(spark.read.format("binaryFile").load(path))


def good_and_quarantined(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    return packets.where("ok"), packets.where(~F.col("ok"))


#: What a recogniser returns for an image: its best text, how sure it is, and the regions that it read.
OCR_DDL = "text string, confidence double, regions array<struct<text: string, confidence: double, bbox: array<array<double>>>>"


def recognise(crops: DataFrame, ocr, image: str = "image") -> DataFrame:
    """``crops`` with ``ocr``: what the function ``ocr`` reads in the images, in batches. It gets a list of images (bytes, or None)
    and returns for each None or a dict of text, confidence and regions ([text, confidence, [[x, y], ...]] with places as parts
    of the image's size). No engine comes with the library."""
    kind = to_arrow_schema(StructType.fromDDL(OCR_DDL))

    def run(images: pa.Array) -> pa.Array:
        rows = []
        for found in ocr(images.to_pylist()):
            rows.append(found and {"text": found["text"], "confidence": float(found["confidence"]), "regions": [{"text": t, "confidence": float(c), "bbox": [[float(x) for x in p] for p in box]} for t, c, box in found.get("regions", ())]})
        return pa.array(rows, pa.struct(list(kind)))

    return crops.withColumn("ocr", F.arrow_udf(run, OCR_DDL)(F.col(image)))
