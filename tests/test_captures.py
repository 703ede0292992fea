"""Captures in byte ranges give the packets of the whole, wherever the ranges are cut; files that grow; the table function."""

import os
import random
import struct

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from gateflow.sources import captures, packets


def capture(rng, n, size):
    """Packets whose images and headers hold marks, parts of marks and anything else."""
    out = b""
    for _ in range(n):
        image = b"".join(rng.choice([b"END", b"!", b"E", b"xy", rng.randbytes(rng.randrange(size))]) for _ in range(rng.randrange(4))).replace(packets.MARK, b"")
        header = bytearray(rng.randbytes(packets.CROP.size))
        for _ in range(rng.randrange(4)):  # a header can look like anything
            at = rng.randrange(len(header) - 4)
            header[at : at + 4] = packets.MARK
        out += image + packets.MARK + bytes(header)
    return out


def whole(data):
    at, out = 0, []
    for image, header in packets.split_packets(data, packets.CROP):
        out.append((at, image, struct.pack("<IIIQ5fIQI", *header)))
        at += len(image) + len(packets.MARK) + packets.CROP.size
    return out


@pytest.mark.parametrize("size", [3, 40, 500])
def test_ranges_find_their_packets(tmp_path, size, monkeypatch):
    rng = random.Random(size)
    monkeypatch.setattr(captures, "LOOK_BACK", 16)
    monkeypatch.setattr(captures, "READ_BYTES", 37)
    for n in (0, 1, 30):
        data = capture(rng, n, size) + rng.choice([b"", b"left over", b"image END!" + b"x" * 20])
        (tmp_path / "c").write_bytes(data)
        want = whole(data)
        for width in (1, 7, 64, 1000, len(data) + 1):
            if width == 1 and size == 500:
                continue
            got = []
            for r in captures._ranges({str(tmp_path / "c"): len(data)}, {}, width):
                got += captures.range_packets(captures.Bytes(fs.LocalFileSystem(), r.uri), r.start, r.end, packets.CROP)
            assert [(a, i, struct.pack("<IIIQ5fIQI", *h)) for a, i, h in got] == want


def test_captures_as_a_table(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.bin", "deep/b.bin"):
        (tmp_path / "in" / name).write_bytes(capture(rng, 60, 200))
    (tmp_path / "in" / "_skipped").write_bytes(b"x")
    want = packets.read_crop_packets(spark, f"{tmp_path}/in/*.bin").unionAll(packets.read_crop_packets(spark, f"{tmp_path}/in/deep/*.bin"))
    columns = [c for c in want.columns if c not in ("path", "pos")]
    plain = lambda df: sorted(repr([bytes(v) if isinstance(v, bytearray) else v for v in r]) for r in df.select(*columns).collect())
    for width in (100, 10**9):
        got = captures.read_captures(spark, f"{tmp_path}/in", range_bytes=width, task_bytes=2000)
        assert plain(got) == plain(want)
    assert captures.read_captures(spark, f"file://{tmp_path}/in/a.bin", range_bytes=1000).count() == 60
    packets.register_table_functions(spark)
    spark.read.format("binaryFile").load(f"{tmp_path}/in/*.bin").unionByName(spark.createDataFrame([("none", None)], "path string, content binary"), allowMissingColumns=True).createOrReplaceTempView("some_captures")
    rows = spark.sql("SELECT p.* FROM some_captures c, LATERAL decode_packets(c.content) p")
    assert plain(rows) == plain(packets.read_crop_packets(spark, f"{tmp_path}/in/*.bin")) and rows.agg(F.max("pos")).first()[0] == 59


def test_a_growing_capture_is_a_stream(spark, tmp_path):
    """A packet comes once, when its header is whole, also where a batch ends in its middle."""
    rng = random.Random(2)
    data = capture(rng, 40, 300)
    path, out, log = tmp_path / "in" / "live.bin", str(tmp_path / "out"), str(tmp_path / "log")
    path.parent.mkdir()
    sizes = []
    for end in (len(data) // 3, len(data) // 3 + 10, 2 * len(data) // 3, len(data)):
        with path.open("ab") as f:
            f.write(data[os.path.getsize(path) : end])
        q = captures.stream_captures(spark, str(path.parent), range_bytes=700, task_bytes=1500).select("offset", "image").writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(spark.read.parquet(out).count())
    rows = spark.read.parquet(out).orderBy("offset").collect()
    assert [(r.offset, bytes(r.image)) for r in rows] == [(a, i) for a, i, _ in whole(data)] and sizes[0] < sizes[2] < sizes[3] == 40
