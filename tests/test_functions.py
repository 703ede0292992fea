"""Column functions, parsers and binary sources on small cases."""

import struct

import pytest
from pyspark.sql import functions as F

from gateflow.functions import geometry as geo
from gateflow.functions import text as txt
from gateflow.operators import aggregates as agg
from gateflow.operators import filters as flt
from gateflow.operators import joins as jn
from gateflow.operators import windows as win
from gateflow.sources import packets, parsers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("code", "valid"), [("CSQU3054383", True), ("csqu 305438-3", True), ("MSCU6639870", True), ("CSQU3054384", False), ("CSQA3054383", False), ("", False), (None, False)])
def test_code(spark, code, valid):
    assert one(spark, txt.is_valid_code(F.lit(code).cast("string"))) is valid


def test_hue_wraps(spark):
    d = geo.hsv_distance(tuple(F.lit(x) for x in (0.98, 0.0, 0.0)), tuple(F.lit(x) for x in (0.02, 0.0, 0.0)))
    assert abs(one(spark, d) - 0.06) < 1e-12


def square():
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))


@pytest.mark.parametrize(("x", "y", "inside"), [(0.5, 0.5, True), (0.0, 0.5, False), (1.0, 1.0, False), (0.5, 1.0, False), (1.5, 0.5, False), (0.999, 0.001, True)])
def test_polygon_is_open(spark, x, y, inside):
    assert one(spark, geo.inside_polygon(F.lit(x), F.lit(y), square())) is inside


def test_box_edges_count(spark):
    cargo = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 0.2, 0.2)], "det_id long, source_id int, frame_num long, bbox_left double, bbox_top double, bbox_width double, bbox_height double")
    trucks = spark.createDataFrame([(7, 70, 0, 1, 0.1, 0.1, 0.5, 0.5), (8, 80, 0, 1, 0.0, 0.0, 1.0, 1.0)], "truck_det long, truck_id long, source_id int, frame_num long, bbox_left double, bbox_top double, bbox_width double, bbox_height double")
    assert [r.truck_det for r in jn.contain_join(cargo, trucks).collect()] == [7]
    assert jn.contain_join(cargo, trucks, "all").count() == 2


@pytest.mark.parametrize(("now", "on"), [("2024-01-10 12:00", False), ("2024-01-10 11:59", True), ("2024-01-10 08:00", True), ("2024-01-11 09:00", False)])
def test_schedule(spark, now, on):
    df = spark.sql("select null valid_from, null valid_until, map('wed', array(array('08:00', '12:00'))) schedule")
    assert df.select(flt.in_schedule(now).alias("x")).first().x is on
    empty = spark.sql("select null valid_from, null valid_until, cast(map() as map<string,array<array<string>>>) schedule")
    assert empty.select(flt.in_schedule(now).alias("x")).first().x is True


def test_gate_before_crossing(spark):
    df = spark.createDataFrame([(0, 1, 10, False, True), (0, 1, 20, True, False)], "source_id int, truck_id long, ts_ms long, crossed boolean, in_roi boolean")
    strict, loose = win.truck_gate(df).first(), win.truck_gate(df, strict=False).first()
    assert (strict.roi_ms, strict.active) == (None, True)
    assert (loose.roi_ms, loose.active) == (10, False)


def test_stream_url(spark):
    made = txt.encode_stream_url(F.lit("rtsp://a b:p@ss@Host:554/x?y=1"))
    assert one(spark, txt.encode_stream_url(F.lit("rtsp://u:p w@Host:554/x?y=1"))) == "rtsp://u:p%20w@host:554/x?y=1"
    assert one(spark, txt.encode_stream_url(F.lit("rtsp://host/x"))) == "rtsp://host/x"
    assert one(spark, made) is not None


def test_malformed_detections_are_dropped(spark):
    good = '{"device_id":1,"source_id":0,"frame_num":7,"timestamp_ms":5,"objects":[{"class_id":0,"object_id":5,"truck_id":9,"confidence":0.8,"bbox":{"left":0.1,"top":0.2,"width":0.1,"height":0.1}}]}'
    df = spark.createDataFrame([(good,), (good.replace('"device_id":1', '"device_id":0'),), (good[:-1],), ("",), (None,)], "body string")
    rows = parsers.parse_detections(df).collect()
    assert [(r.device_id, r.ts_ms, r.truck_id, r.bbox_top) for r in rows] == [(1, 5, 9, 0.2)]


def test_camera_lines(spark):
    lines = ['Code=A;action=Start;index=2;data={"k":"v;w"}', "Code=B;data=oops", "index=1", ""]
    rows = parsers.parse_camera_events(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.code, r.action, r["index"]) for r in rows] == [("A", "Start", 2), ("B", "Unknown", 0)]
    assert rows[0].data == {"k": "v;w"}


def test_text_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("0=0.30\n1=0.45\n99=0.5\n3=0\n")
    (tmp_path / "l.txt").write_text("a\nb\n\nc\n")
    assert sorted(map(tuple, parsers.read_thresholds(spark, str(tmp_path / "t.txt")).collect())) == [(0, 0.3), (1, 0.45)]
    assert [r.label for r in parsers.read_labels(spark, str(tmp_path / "l.txt")).orderBy("class_id").collect()] == ["a", "b", "c"]


def crop(image, device=1, size=None):
    return image + packets.MARK + struct.pack("<IIIQ5fIQI", device & 0xFFFFFFFF, 2, 3, 2**63 + 1, 0.5, 0.25, 0.5, 0.125, 0.25, 9, 1700, len(image) if size is None else size)


def test_crop_packets(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(crop(b"one") + crop(b"", -1) + crop(b"three", size=4) + b"cut off")
    rows = packets.read_crop_packets(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.device_id, bytes(r.image), r.ok, int(r.object_id), r.bbox_height) for r in rows] == [(1, b"one", True, 2**63 + 1, 0.25), (-1, b"", True, 2**63 + 1, 0.25), (1, b"three", False, 2**63 + 1, 0.25)]
    good, bad = packets.good_and_quarantined(packets.read_crop_packets(spark, str(tmp_path)))
    assert (good.count(), bad.count()) == (2, 1)


def test_snapshot_packets(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"img" + packets.MARK + struct.pack("<II16s4fQI", 5, 1, b"lc", 0.5, 0.5, 0.25, 0.25, 77, 3))
    r = packets.read_snapshot_packets(spark, str(tmp_path)).first()
    assert (r.device_id, r.kind, int(r.ts_ms), r.ok) == (5, "lc", 77, True)


def test_packets_round_trip(spark):
    rows = [("a", 1, -1, 2, "lc", 0.5, 0.25, 0.125, 1.0, 77, 3, b"two"), ("a", 0, 5, 1, "roi", 0.5, 0.5, 0.25, 0.25, 7, 9, b""), ("b", 0, 5, 1, "oc", 0.0, 0.0, 0.0, 0.0, 2**40, 1, b"x")]
    df = spark.createDataFrame(rows, "path string, pos int, device_id int, source_id int, kind string, bbox_left double, bbox_top double, bbox_width double, bbox_height double, ts_ms long, size long, image binary")
    got = packets.decode_snapshot_packets(packets.encode_packets(df, "snapshot")).withColumn("ts_ms", F.col("ts_ms").cast("long")).collect()
    assert sorted((*(r[c] for c in df.columns[:-1]), bytes(r.image)) for r in got) == sorted(rows)
    assert packets.decode_crop_packets(spark.createDataFrame([("a", None)], "path string, content binary")).count() == 0


def test_any_recogniser(spark):
    def ocr(images):
        return [None if x is None else {"text": bytes(x).decode().upper(), "confidence": 0.75, "regions": [[bytes(x).decode(), 0.5, [[0, 0], [1, 1]]]]} for x in images]

    got = {r.id: r.ocr for r in packets.recognise(spark.createDataFrame([(1, b"ab"), (2, None)], "id int, image binary"), ocr).collect()}
    assert got[2] is None and (got[1].text, got[1].confidence, got[1].regions[0].bbox) == ("AB", 0.75, [[0.0, 0.0], [1.0, 1.0]])


def test_live_sink_to_a_function(spark, tmp_path):
    spark.range(5).selectExpr("id AS det_id", "cast(id % 2 AS int) AS device_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("det_id long, device_id int").parquet(str(tmp_path / "in"))
    seen = []
    sinks.live_sink(stream, None, str(tmp_path / "log"), to=lambda batch, _: seen.extend(batch.collect())).awaitTermination()
    assert sorted(r.key for r in seen) == ["0", "0", "0", "1", "1"]


def bmp(pixels, width):
    """A 24-bit bitmap of (r, g, b) rows."""
    rows = [pixels[k : k + width] for k in range(0, len(pixels), width)][::-1]
    body = b"".join(b"".join(bytes((b, g, r)) for r, g, b in row) + b"\0" * (-3 * width % 4) for row in rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, len(rows), 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_image_colour_files_equal_pixels(spark, tmp_path):
    px = [((k * 7) % 256, (k * 13) % 256, (k * 29) % 256) for k in range(400)]
    (tmp_path / "a.bmp").write_bytes(bmp(px, 20))
    (tmp_path / "b.bmp").write_bytes(bmp([(0, 0, 0)] * 400, 20))
    files = {r.image.rsplit("/", 1)[1]: r for r in agg.image_hsv_files(spark.read.format("image").load(str(tmp_path))).collect()}
    table = spark.createDataFrame([("a.bmp", *p) for p in px], "image string, r int, g int, b int")
    want = agg.image_hsv(table).first()
    assert files["b.bmp"].n == 0 and files["b.bmp"].h is None
    assert files["a.bmp"].n == want.n
    assert all(abs(files["a.bmp"][c] - want[c]) < 1e-9 for c in "hsv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 1_700_000_000_000, 3)], "det_id long, device_id int, ts_ms long, source_id int")
    sinks.write_detections(df, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d")).first()
    assert (back.det_id, back.device_id, str(back.date)) == (1, 2, "2023-11-14")
    cross = spark.createDataFrame([(5, 0, 9)], "ts_ms long, source_id int, truck_id long")
    line = sinks.truck_timeline(cross, cross, cross.withColumn("class_id", F.lit(3)))
    sinks.write_truck_csv(line, str(tmp_path / "c"))
    assert sorted(r.event for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["CARGO", "CROSS", "ROI_IN"]
    m = sinks.to_live_message(df).first()
    assert (m.key, m.value) == ("2", '{"det_id":1,"device_id":2,"ts_ms":1700000000000,"source_id":3}')


def test_no_nested_loops(spark):
    """Spatial and temporal joins stay equi-joins."""
    from gateflow.plans import registry

    for name in ("jn3_contain_all", "jn4_roi_join", "jn6_prev_event", "jn7_open_event_at", "jn17_pair_score", "agg3_code_consensus", "evt1b_assign_events_fast", "evt4_split_events"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
