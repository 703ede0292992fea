"""Queries of sources, sinks, projections and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import metrics as met
from ..functions import text as txt
from ..operators import filters as flt
from ..sources import captures, packets, sinks
from ..sources import parsers as src
from ..streaming.run import shared_dir
from .registry import query

BOX = "bbox_left, bbox_top, bbox_width, bbox_height"


def jsons(df, *columns):
    """Nested columns as text, so that both engines compare them alike."""
    return df.withColumns({c: F.array_join(F.col(c), ";") for c in columns})


@query("src3_parse_detections", f"""
SELECT device_id, source_id, frame_num, ts_ms, class_id, object_id, truck_id, confidence, {BOX} FROM (
  SELECT min(device_id) AS device_id, min(source_id) AS source_id, frame_num, min(ts_ms) AS ts_ms, min(class_id) AS class_id, min(object_id) AS object_id, max(object_id) AS truck_id, 0.5e0 AS confidence, 0.25e0 AS bbox_left, 0.5e0 AS bbox_top, 0.125e0 AS bbox_width, 0.25e0 AS bbox_height FROM detections GROUP BY frame_num
  UNION ALL SELECT min(device_id), min(source_id), frame_num, min(ts_ms), max(class_id), max(object_id), -1, 0.75e0, 0.5e0, 0.5e0, 0.125e0, 0.25e0 FROM detections GROUP BY frame_num)
WHERE frame_num % 17 <> 0 AND frame_num % 19 <> 0 AND ts_ms <> 0""", ("detections",))
def _(v):
    return src.parse_detections(v("frames_json"))


@query("src4_parse_detections_v2", f"""
SELECT -1 AS device_id, min(source_id) AS source_id, frame_num, min(ts_ms) AS ts_ms, min(class_id) AS class_id, cast(NULL AS bigint) AS object_id, max(object_id) AS truck_id, 0.5e0 AS confidence, 0.25e0 AS bbox_left, 0.5e0 AS bbox_top, 0.125e0 AS bbox_width, 0.25e0 AS bbox_height FROM detections GROUP BY frame_num""", ("detections",))
def _(v):
    return src.parse_detections_v2(v("frames_json2"))


@query("src5_parse_truck_events", """
SELECT CASE WHEN truck_det % 2 = 0 THEN 'CROSS' ELSE 'ROI_IN' END AS event, source_id, truck_id, ts_ms, 'r1' AS roi_name,
  CASE WHEN truck_det % 3 <> 0 THEN cast(truck_det % 4 AS int) END AS cargo_class, CASE WHEN truck_det % 3 <> 0 THEN 0.5e0 END AS cargo_confidence FROM trucks""", ("trucks",))
def _(v):
    return src.parse_truck_events(v("truck_json"))


@query("src6_parse_camera_events", """
SELECT event_id AS line_id, event_type AS code, CASE WHEN event_id % 5 = 0 THEN 'Unknown' WHEN event_id % 7 = 0 THEN 'Stop' ELSE 'Start' END AS action,
  cast(CASE WHEN event_id % 5 = 0 OR event_id % 7 <> 0 THEN event_id % 4 ELSE 0 END AS int) AS "index",
  CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN '' ELSE regexp_extract(props, '"k": *([0-9]+)', 1) END AS k FROM events WHERE event_id % 13 <> 0""")
def _(v):
    return src.parse_camera_events(v("camera_lines")).select("line_id", "code", "action", "index", F.coalesce(F.try_element_at("data", F.lit("k")), F.lit("")).alias("k"))


@query("src7_parse_config_table", """
SELECT s_suppkey AS device_id, 'VideoAnalyseRule' AS path, '0;0' AS indices, 'Name' AS field, concat('rule', s_suppkey) AS value FROM supplier
UNION ALL SELECT s_suppkey, 'VideoAnalyseRule', '0;0', 'Enable', 'true' FROM supplier
UNION ALL SELECT s_suppkey, 'VideoAnalyseRule', '0;0', 'Direction', 'LeftToRight' FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_suppkey, 'VideoAnalyseRule', '0;1', 'Type', 'CrossLineDetection' FROM supplier
UNION ALL SELECT s_suppkey, 'MotionDetect.Window', '0;2', 'Sensitive', cast(s_suppkey % 9 AS varchar) FROM supplier""")
def _(v):
    return jsons(src.parse_config_table(v("config_lines")), "indices")


@query("src8_ivs_rules", """
SELECT s_suppkey AS device_id, 0 AS "index", concat('rule', s_suppkey) AS name, '' AS rule_type, true AS enable, CASE WHEN s_suppkey % 3 = 0 THEN 'Both' ELSE 'LeftToRight' END AS direction FROM supplier
UNION ALL SELECT s_suppkey, 1, 'Rule 1', 'CrossLineDetection', false, 'Both' FROM supplier""")
def _(v):
    return src.ivs_rules(src.parse_config_table(v("config_lines")))


@query("src9_parse_ini_rows", """
SELECT s_suppkey AS file_id, 'property' AS section, 'enable' AS key, '1' AS "values", 2 AS line FROM supplier
UNION ALL SELECT s_suppkey, concat('roi-filtering-stream-', s_suppkey), 'roi-RF', concat('1;2;', s_suppkey), 5 FROM supplier
UNION ALL SELECT s_suppkey, concat('roi-filtering-stream-', s_suppkey), 'class-id', cast(s_suppkey % 4 AS varchar), 6 FROM supplier
UNION ALL SELECT s_suppkey, concat('roi-filtering-stream-', s_suppkey), 'class-id', '7', 7 FROM supplier""")
def _(v):
    return jsons(src.parse_ini_rows(v("ini_files")), "values")


@query("src11_parse_metrics", """
SELECT event_id AS id, event_id * 30000 AS created_ms, cast(event_id % 100 AS double) AS cpu, cast(event_id % 90 AS double) AS ram, event_id % 8 = 0 AS gpu FROM events WHERE event_id % 4 = 0""")
def _(v):
    return met.parse_metrics(v("metric_snapshots"), "system").select("id", "created_ms", F.col("cpu.percent").alias("cpu"), F.col("memory.percent").alias("ram"), F.col("gpu.available").alias("gpu"))


@query("src12_scan_crops", """
SELECT concat('/m/crops/2024/03/0', 1 + det_id % 9, '/dev', device_id, '_src', source_id, '_cls', class_id, '_obj', object_id, '_', ts_ms, '.jpg') AS path,
  concat('2024-03-0', 1 + det_id % 9) AS date, device_id, source_id, class_id, object_id, ts_ms FROM detections""", ("detections",))
def _(v):
    name = "concat('/m/crops/2024/03/0', 1 + det_id % 9, '/dev', device_id, '_src', source_id, '_cls', class_id, '_obj', object_id, '_', ts_ms, '.jpg')"
    return src.scan_crops(v("detections").select(F.expr(name).alias("path")))


@query("src13_load_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(v):
    return src.load_table(v.spark, "supplier", v.sf_dir)


@query("src14_parse_source_map", """
SELECT (s_suppkey - 1)::INT AS source_id, CASE WHEN s_suppkey % 5 = 1 THEN s_suppkey::INT END AS device_id, concat('rtsp://h', s_suppkey - 1) AS url, cast(s_suppkey + 19 AS varchar) AS fps FROM supplier""")
def _(v):
    plain, attrs = src.parse_source_map(v("source_map"))
    return attrs.join(plain, "source_id", "left").select("source_id", "device_id", "url", "fps")


@query("snk1_truck_timeline", """
SELECT ts_ms AS ts, CASE WHEN crossed THEN 'CROSS' ELSE 'ROI_IN' END AS event, source_id AS src, truck_id AS truck, '' AS cls, '' AS roi FROM truck_analytics WHERE crossed
UNION ALL SELECT ts_ms, 'ROI_IN', source_id, truck_id, '', '' FROM truck_analytics WHERE in_roi
UNION ALL SELECT ts_ms, 'CARGO', source_id, object_id, cast(class_id AS varchar), roi_name FROM cargo WHERE class_id = 3""", ("truck_analytics", "cargo"))
def _(v):
    t = v("truck_analytics")
    cargo = v("cargo").where("class_id = 3").withColumn("truck_id", F.col("object_id"))
    return sinks.truck_timeline(t.where("crossed"), t.where("in_roi"), cargo).select("ts", "event", "src", "truck", "cls", "roi")


@query("snk4_to_api_json", """
SELECT event_id, concat('{"event_id":', event_id, ',"code":"', event_type, '","timestamp":"', strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%S'), '.000Z"}') AS json FROM events""")
def _(v):
    return sinks.to_api_json(v("camera_events").select("event_id", "code", "ts_ms"))


@query("snk5_nest_frames", """
SELECT source_id, frame_num, cast(count(*) AS int) AS n_objects, min(ts_ms) AS timestamp_ms, string_agg(concat(class_id, ':', object_id), ',' ORDER BY det_id) AS objects FROM detections GROUP BY source_id, frame_num""", ("detections",))
def _(v):
    d = sinks.nest_frames(v("detections"))
    o = F.from_json("document", "timestamp_ms long, objects array<struct<class_id:int,object_id:long>>")
    return d.withColumn("d", o).select("source_id", "frame_num", "n_objects", "d.timestamp_ms", F.array_join(F.transform("d.objects", lambda x: F.concat_ws(":", x.class_id, x.object_id)), ",").alias("objects"))


@query("prj1_normalize_bbox", "SELECT det_id, bbox_left * 1000 / 1920 AS bbox_left, bbox_width * 1000 / 1920 AS bbox_width, bbox_top * 1000 / 1080 AS bbox_top, bbox_height * 1000 / 1080 AS bbox_height FROM detections", ("detections",))
def _(v):
    return geo.normalize_bbox(v("detections").selectExpr("det_id", *(f"{c} * 1000 AS {c}" for c in geo.BOX)))


@query("prj2_bbox_to_px", "SELECT det_id, cast(trunc(bbox_left * 1920) AS int) AS x1, cast(trunc(bbox_top * 1080) AS int) AS y1, cast(trunc((bbox_left + bbox_width) * 1920) AS int) AS x2, cast(trunc((bbox_top + bbox_height) * 1080) AS int) AS y2 FROM detections", ("detections",))
def _(v):
    return geo.bbox_to_px(v("detections")).select("det_id", "x1", "y1", "x2", "y2")


@query("prj3_with_center", "SELECT det_id, bbox_left + bbox_width / 2 AS cx, bbox_top + bbox_height / 2 AS cy FROM detections", ("detections",))
def _(v):
    return geo.with_center(v("detections")).select("det_id", "cx", "cy")


@query("prj4_pad_bbox", """SELECT det_id, bbox_left, CASE WHEN class_id = 3 THEN bbox_left - bbox_width * 0.05e0 ELSE bbox_left END AS crop_left, CASE WHEN class_id = 3 THEN bbox_width * 1.1e0 ELSE bbox_width END AS crop_width,
 CASE WHEN class_id = 3 THEN bbox_top - bbox_height * 0.05e0 ELSE bbox_top END AS crop_top, CASE WHEN class_id = 3 THEN bbox_height * 1.1e0 ELSE bbox_height END AS crop_height FROM detections""", ("detections",))
def _(v):
    return geo.pad_bbox(v("detections")).select("det_id", "bbox_left", *(f"crop_{c}" for c in ("left", "width", "top", "height")))


@query("prj5_with_zone", "SELECT det_id, CASE WHEN source_id = 0 THEN CASE WHEN bbox_left + bbox_width / 2 < 0.5 THEN 'IN' ELSE 'OUT' END ELSE CASE WHEN bbox_left + bbox_width / 2 < 0.5 THEN 'OUT' ELSE 'IN' END END AS zone FROM detections WHERE class_id = 4", ("detections",))
def _(v):
    return geo.with_zone(v("detections").where("class_id = 4")).select("det_id", "zone")


@query("prj6_with_label", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'con_sello' WHEN 1 THEN 'sin_sello' WHEN 2 THEN 'cont data' WHEN 3 THEN 'container cod' WHEN 4 THEN 'truck' ELSE 'unknown' END AS label FROM events")
def _(v):
    return txt.with_label(v("events").selectExpr("event_id", "cast(event_id % 7 AS int) AS class_id")).select("event_id", "label")


@query("prj7_with_ts", "SELECT det_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') AS ts FROM detections", ("detections",))
def _(v):
    return txt.with_ts(v("detections")).select("det_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("prj8_with_caption", "SELECT det_id, concat(CASE class_id WHEN 0 THEN 'con_sello' WHEN 1 THEN 'sin_sello' WHEN 2 THEN 'cont data' WHEN 3 THEN 'container cod' ELSE 'truck' END, ' ', printf('%.2f', cast(det_id % 100 AS double) / 100), CASE WHEN ocr_text <> '' THEN concat(' [', ocr_text, ']') ELSE '' END) AS caption FROM detections", ("detections",))
def _(v):
    d = txt.with_label(v("detections")).withColumn("confidence", F.expr("cast(det_id % 100 AS double) / 100"))
    return txt.with_caption(d).select("det_id", "caption")


@query("prj9_hsv_distance", "SELECT det_id, sqrt(power(1.5 * least(abs(color_h - 0.9e0), 1 - abs(color_h - 0.9e0)), 2) + power(color_s - 0.2e0, 2) + power(0.5 * (color_v - 0.4e0), 2)) AS distance FROM detections WHERE color_h IS NOT NULL", ("detections",))
def _(v):
    here = tuple(F.col(f"color_{c}") for c in "hsv")
    return v("detections").where("color_h is not null").select("det_id", geo.hsv_distance(here, tuple(F.lit(x) for x in (0.9, 0.2, 0.4))).alias("distance"))


_DIGIT = """
WITH c AS (SELECT DISTINCT concat('CS', substr('ABQUZJ', cast(1 + o_orderkey % 6 AS int), 1), substr('UJZA', cast(1 + o_custkey % 4 AS int), 1), lpad(cast(o_orderkey * 7919 % 1000000 AS varchar), 6, '0'), cast(o_custkey % 10 AS varchar)) AS code FROM orders),
x AS (SELECT code, sum((instr('0123456789A_BCDEFGHIJK_LMNOPQRSTU_VWXYZ', substr(code, i::INT, 1)) - 1) * power(2, i - 1)::BIGINT)::BIGINT AS s FROM c, range(1, 11) r(i) GROUP BY code)
SELECT code, substr(code, 4, 1) IN ('U', 'J', 'Z') AND s % 11 % 10 = cast(substr(code, 11, 1) AS int) AS valid FROM x"""


@query("prj10_is_valid_code", _DIGIT)
def _(v):
    codes = v("orders").selectExpr("concat('CS', substr('ABQUZJ', cast(1 + o_orderkey % 6 AS int), 1), substr('UJZA', cast(1 + o_custkey % 4 AS int), 1), lpad(cast(o_orderkey * 7919 % 1000000 AS string), 6, '0'), cast(o_custkey % 10 AS string)) AS code").distinct()
    return codes.select("code", txt.is_valid_code(F.col("code")).alias("valid"))


@query("prj11_extract_codes", "SELECT det_id, array_to_string(regexp_extract_all(upper(ocr_text), '[A-Z]{4}[0-9]{7}'), ';') AS codes FROM detections WHERE class_id = 3", ("detections",))
def _(v):
    return v("detections").where("class_id = 3").select("det_id", F.array_join(txt.extract_codes(F.col("ocr_text")), ";").alias("codes"))


def _regions(v):
    box = F.when(F.col("x").isNotNull(), F.array(F.array("x", F.lit(0.0)))).otherwise(F.array().cast("array<array<double>>"))
    r = v("ocr_regions").groupBy("det_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "conf", box.alias("bbox"), "x"))).alias("r"))
    return r.select("det_id", F.transform("r", lambda r: F.struct(r.text.alias("text"), r.conf.alias("conf"), r.bbox.alias("bbox"), r.x.alias("x"))).alias("regions"))


@query("prj12_ocr_full_text", """
SELECT DISTINCT d.det_id, coalesce(t, '') AS full_text FROM (SELECT det_id, count(*) FILTER (x IS NOT NULL AND conf >= 0.6) AS b FROM ocr_regions GROUP BY det_id) d
LEFT JOIN LATERAL (SELECT string_agg(upper(text), '' ORDER BY CASE WHEN d.b > 0 THEN x END, pos) AS t FROM ocr_regions r WHERE r.det_id = d.det_id AND conf >= 0.6 AND (d.b = 0 OR x IS NOT NULL)) ON true""", ("ocr_regions",))
def _(v):
    return _regions(v).select("det_id", txt.ocr_full_text(F.col("regions")).alias("full_text"))


@query("prj13_ocr_lines", """
SELECT doc_id, len(l)::INT AS n, l[1] AS best FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t: trim(t, ' ')), lambda t: t <> '') AS l FROM documents)""")
def _(v):
    d = txt.ocr_lines(v("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw")))
    return d.select("doc_id", F.size("regions").alias("n"), "best")


@query("prj14_ocr_best_region", """
SELECT det_id, b.text AS best_text, b.conf AS best_conf, b.x / 1920 AS best_x FROM (
 SELECT det_id, arg_min({'text': text, 'conf': conf, 'x': x}, (1000 - conf * 100) * 1000 + pos) FILTER (conf >= 0.6 AND trim(text) <> '') AS b FROM ocr_regions GROUP BY det_id)""", ("ocr_regions",))
def _(v):
    return txt.ocr_best_region(_regions(v).withColumn("width", F.lit(1920))).select("det_id", "best_text", "best_conf", "best_x")


@query("prj15_ocr_coalesce", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'one' WHEN event_id % 5 <> 0 THEN 'two' WHEN event_id % 7 <> 0 THEN 'three' END AS ocr FROM events")
def _(v):
    d = v("events").selectExpr("event_id", "if(event_id % 3 = 0, '  ', ' one') AS a", "if(event_id % 5 = 0, null, 'two ') AS b", "if(event_id % 7 = 0, '', 'three') AS c")
    return txt.ocr_coalesce(d, "a", "b", "c").select("event_id", "ocr")


def shapes(v):
    return with_shapes(v("presets"))


def with_shapes(presets):
    """Presets with a rectangle each, as closed polygons."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    points = F.array(corner(x0, y0), corner(x0 + w, y0), corner(x0 + w, y0 + h), corner(x0, y0 + h))
    shape = F.struct(F.col("preset_name").alias("name"), F.lit(True).alias("isClosed"), points.alias("points"))
    none = F.array().cast("array<struct<name:string,isClosed:boolean,points:array<struct<x:double,y:double>>>>")
    return presets.withColumns({"shapes": F.when(F.col("has_shapes"), F.array(shape)).otherwise(none), "points": points})


@query("prj16_shapes_to_coords", "SELECT preset_id, concat_ws(';', round_even(x0 * 1280, 0)::INT, round_even(y0 * 720, 0)::INT, round_even((x0 + w) * 1280, 0)::INT, round_even(y0 * 720, 0)::INT, round_even((x0 + w) * 1280, 0)::INT, round_even((y0 + h) * 720, 0)::INT, round_even(x0 * 1280, 0)::INT, round_even((y0 + h) * 720, 0)::INT) AS coords FROM presets", ("presets",))
def _(v):
    return geo.shapes_to_coords(shapes(v)).select("preset_id", "coords")


@query("prj17_polygon_anchor", "SELECT preset_id, (x0 + (x0 + w) + (x0 + w) + x0) / 4 AS x, (y0 + y0 + (y0 + h) + (y0 + h)) / 4 AS y FROM presets", ("presets",))
def _(v):
    x, y = geo.polygon_anchor("points")
    return shapes(v).select("preset_id", x.alias("x"), y.alias("y"))


@query("prj18_dist_to_segment", """
SELECT det_id, round(sqrt(power(cx - (0.1e0 + t * 0.5e0), 2) + power(cy - (0.2e0 + t * 0.3e0), 2)), 9) AS d FROM (SELECT det_id, cx, cy, greatest(0, least(1, ((cx - 0.1e0) * 0.5e0 + (cy - 0.2e0) * 0.3e0) / 0.34e0)) AS t FROM tracks)""", ("tracks",))
def _(v):
    d = geo.dist_to_segment(F.col("cx"), F.col("cy"), *(F.lit(x) for x in (0.1, 0.2, 0.6, 0.5)))
    return v("tracks").select("det_id", F.round(d, 9).alias("d"))


@query("prj19_to_pan_tilt", """
SELECT det_id, round(greatest(-1, least(1, 0.9e0 + (cx - 0.5e0) * (99.1e0 * (1 - z) + 31.9e0 * z) / 177.5e0)), 9) AS new_pan, round(greatest(-1, least(1, -0.2e0 + (0.5e0 - cy) * (53.4e0 * (1 - z) + 18.0e0 * z) / 45.0e0)), 9) AS new_tilt FROM (SELECT *, cast(det_id % 11 AS double) / 10 AS z FROM tracks)""", ("tracks",))
def _(v):
    d = v("tracks").selectExpr("det_id", "cx AS x", "cy AS y", "cast(det_id % 11 AS double) / 10 AS zoom", "0.9D AS pan", "-0.2D AS tilt")
    return geo.to_pan_tilt(txt.with_specs(d)).select("det_id", F.round("new_pan", 9).alias("new_pan"), F.round("new_tilt", 9).alias("new_tilt"))


@query("prj20_with_specs", "SELECT id, coalesce(h_fov_wide, 99.1e0) AS h_fov_wide, 18.0e0 AS v_fov_tele, 355.0e0 AS pan_range FROM devices", ("devices",))
def _(v):
    return txt.with_specs(v("devices")).select("id", "h_fov_wide", "v_fov_tele", "pan_range")


@query("prj21_stream_name", "SELECT id, CASE WHEN id % 13 = 0 THEN '' ELSE concat('cam_', id, '_', default_token, CASE WHEN source_type = 'file' THEN '' ELSE '_hw' END) END AS stream FROM devices", ("devices",))
def _(v):
    token = F.when(F.col("id") % 13 != 0, F.col("default_token"))
    return v("devices").select("id", txt.stream_name(F.col("id"), token, F.col("source_type") == "file").alias("stream"))


@query("prj22_encode_stream_url", "SELECT id, CASE WHEN username = '' THEN concat('rtsp://Host', id, ':554/a?b=1') ELSE concat('rtsp://', username, '%20x:p%40%2F', id, '~@host', id, ':554/a?b=1') END AS url FROM devices", ("devices",))
def _(v):
    d = v("devices").withColumn("u", F.when(F.col("username") == "", "").otherwise(F.concat("username", F.lit(" x"))))
    url = F.concat(F.lit("rtsp://Host"), F.col("id"), F.lit(":554/a?b=1"))
    return d.select("id", txt.encode_stream_url(url, F.col("u"), F.concat(F.lit("p@/"), F.col("id"), F.lit("~"))).alias("url"))


@query("prj23_parse_scopes", "SELECT id, concat('n', id) AS scope_name, CASE WHEN id % 2 = 0 THEN 'hw2' ELSE 'hw1' END AS hardware, 'Streaming;T' AS profiles FROM devices", ("devices",))
def _(v):
    s = "transform(array(concat('onvif://www.onvif.org/name/n', id), 'onvif://www.onvif.org/hardware/hw1', if(id % 2 = 0, 'onvif://www.onvif.org/hardware/hw2', 'onvif://x'), 'onvif://www.onvif.org/Profile/Streaming', 'onvif://www.onvif.org/Profile/T'), x -> x)"
    return jsons(txt.parse_scopes(v("devices").selectExpr("id", f"{s} AS scopes")), "profiles").select("id", "scope_name", "hardware", "profiles")


@query("prj24_uptime", """SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN round_even(event_id * 7777 / 100, 0)::BIGINT END AS uptime_s, CASE WHEN event_id % 9 <> 0 THEN concat(round_even(event_id * 7777 / 100, 0)::BIGINT // 3600, 'h ', round_even(event_id * 7777 / 100, 0)::BIGINT % 3600 // 60, 'm') END AS uptime FROM events""")
def _(v):
    up = met.uptime_seconds(F.expr("if(event_id % 9 = 0, 'x', cast(event_id * 7777 AS string))"))
    return v("events").select("event_id", up.alias("uptime_s"), met.uptime_text(up).alias("uptime"))


@query("prj25_mem_pct", "SELECT tick, round_even(mem_bytes / 1048576, 1) AS mem_mb, CASE WHEN mem_limit > 0 THEN round_even(mem_bytes / mem_limit * 100, 1) ELSE 0 END AS mem_pct FROM containers", ("containers",))
def _(v):
    return met.mem_pct(v("containers")).select("tick", "mem_mb", "mem_pct")


@query("prj26_cpu_pct", "SELECT tick, CASE WHEN cpu_total - cpu_before > 0 AND sys_total - sys_before > 0 THEN round_even((cpu_total - cpu_before) / (sys_total - sys_before) * 4 * 100, 1) ELSE 0 END AS cpu_pct FROM containers", ("containers",))
def _(v):
    return met.cpu_pct(v("containers")).select("tick", "cpu_pct")


def devices(v, name="devices"):
    uris = F.map_filter(F.create_map(F.lit("tok_a"), "uri_a", F.lit("tok_b"), "uri_b"), lambda _, x: x.isNotNull())
    return v(name).withColumn("stream_uris", uris)


@query("prj27_stream_profiles", """
SELECT id, 'tok_a' AS token, 'tok_a' AS name, uri_a AS uri, ptz, true AS is_default FROM devices WHERE uri_a IS NOT NULL
UNION ALL SELECT id, 'tok_b', 'tok_b', uri_b, ptz, uri_a IS NULL FROM devices WHERE uri_b IS NOT NULL""", ("devices",))
def _(v):
    return met.stream_profiles(devices(v))


#: Detections as captures of a minute and device; every 13th header tells a wrong size.
_CAPTURE = "concat('dev', cast(device_id AS varchar(9)), '/', cast(cast(floor(ts_ms / 60000) AS bigint) AS varchar(20)))"
_IMAGE = "concat('img', cast(det_id AS varchar(20)), ' ', ocr_text)"
_PACKED = f"""SELECT {_CAPTURE} AS path, row_number() OVER (PARTITION BY {_CAPTURE} ORDER BY ts_ms, det_id) - 1 AS pos, device_id, source_id, class_id, object_id, confidence,
  {BOX}, frame_num, ts_ms, {_IMAGE} AS image, length({_IMAGE}) + CASE WHEN det_id % 13 = 0 THEN 1 ELSE 0 END AS size, CASE class_id % 3 WHEN 0 THEN 'roi' WHEN 1 THEN 'lc' ELSE 'oc' END AS kind FROM detections"""
_WIRE = ", ".join(f"cast(cast({c} AS float) AS double) AS {c}" for c in BOX.split(", "))


def _packed(v):
    v("detections")
    return v.spark.sql(_PACKED).withColumn("image", F.col("image").cast("binary"))


@query("src1_read_crop_packets", f"SELECT path, pos::INT AS pos, device_id, source_id, class_id, object_id, cast(cast(confidence AS float) AS double) AS confidence, {_WIRE}, frame_num, ts_ms, size, size = length(image) AS ok, image FROM ({_PACKED})", ("detections",))
def _(v):
    files = packets.encode_packets(_packed(v), "crop")
    return packets.decode_crop_packets(files).withColumns({"image": F.col("image").cast("string"), "object_id": F.col("object_id").cast("long"), "ts_ms": F.col("ts_ms").cast("long")})


@query("src2_read_snapshot_packets", f"SELECT path, pos::INT AS pos, device_id, source_id, kind, {_WIRE}, ts_ms, size, size = length(image) AS ok, image FROM ({_PACKED})", ("detections",))
def _(v):
    files = packets.encode_packets(_packed(v), "snapshot")
    return packets.decode_snapshot_packets(files).withColumns({"image": F.col("image").cast("string"), "ts_ms": F.col("ts_ms").cast("long")})


@query("src1_capture_ranges", f"SELECT path, device_id, source_id, class_id, object_id, cast(cast(confidence AS float) AS double) AS confidence, {_WIRE}, frame_num, ts_ms, size, size = length(image) AS ok, image FROM ({_PACKED})", ("detections",))
def _(v):
    """The same captures as files, in ranges of 4000 bytes, a megabyte of them a task."""
    folder = f"{shared_dir(v.spark)}/captures-{uuid.uuid4().hex}"
    captures.write_captures(packets.encode_packets(_packed(v), "crop"), folder).agg(F.sum("size")).first()
    rows = captures.read_captures(v.spark, folder, range_bytes=4000, task_bytes=1 << 20).drop("offset")
    return rows.withColumns({"path": F.substring_index("path", f"{folder.rsplit('/', 1)[1]}/", -1), "image": F.col("image").cast("string"), "object_id": F.col("object_id").cast("long"), "ts_ms": F.col("ts_ms").cast("long")})


@query("udtf_decode_packets", f"SELECT path, pos::INT AS pos, device_id, source_id, class_id, object_id, cast(cast(confidence AS float) AS double) AS confidence, {_WIRE}, frame_num, ts_ms, size, size = length(image) AS ok, image FROM ({_PACKED})", ("detections",))
def _(v):
    packets.register_table_functions(v.spark)
    packets.encode_packets(_packed(v), "crop").createOrReplaceTempView("captures")
    rows = v.spark.sql("SELECT c.path, p.* FROM captures c, LATERAL decode_packets(c.content) p")
    return rows.withColumns({"image": F.col("image").cast("string"), "object_id": F.col("object_id").cast("long"), "ts_ms": F.col("ts_ms").cast("long")})


@query("src10_read_thresholds", "SELECT (o_orderkey % 20 - 2)::INT AS class_id, (o_orderkey % 7 - 1) / 4 AS threshold FROM orders WHERE o_orderkey % 20 - 2 BETWEEN 0 AND 15 AND o_orderkey % 7 > 1")
def _(v):
    folder = f"{shared_dir(v.spark)}/thresholds-{uuid.uuid4().hex}"
    v("orders").selectExpr("concat(o_orderkey % 20 - 2, '=', (o_orderkey % 7 - 1) / 4)").write.text(folder)
    return src.read_thresholds(v.spark, folder)


@query("snk2_write_detections", "SELECT det_id, device_id, ts_ms, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS date FROM detections", ("detections",))
def _(v):
    folder = f"{shared_dir(v.spark)}/detections-{uuid.uuid4().hex}"
    sinks.write_detections(v("detections"), folder)
    return v.spark.read.parquet(folder).select("det_id", "device_id", "ts_ms", F.col("date").cast("string").alias("date"))


@query("prj28_system_series", """SELECT event_id AS id, event_id * 30000 AS created_ms, cast(event_id % 100 AS double) AS cpu, cast(event_id % 90 AS double) AS ram, CASE WHEN event_id % 8 = 0 THEN cast(event_id % 70 AS double) END AS gpu_util, CASE WHEN event_id % 8 = 0 THEN 1838.0e0 END AS gpu_mem, CASE WHEN event_id % 8 = 0 THEN 66.0e0 END AS gpu_temp FROM events WHERE event_id % 4 = 0""")
def _(v):
    return met.system_series(met.parse_metrics(v("metric_snapshots"), "system"))


@query("prj29_flatten_streams", """
SELECT event_id AS id, 'a' AS name, true AS online, 2 AS readers_count, round_even(event_id * 1000 / 1048576, 1) AS mb FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 'b', event_id % 3 = 0, 1, 0 FROM events WHERE event_id % 4 = 1""")
def _(v):
    return met.flatten_streams(met.parse_metrics(v("metric_snapshots"), "mediamtx"))


@query("prj30_snmp_rows", """
SELECT event_id AS id, 1 AS device_id, CASE WHEN event_id % 3 = 0 THEN 'd' ELSE 'sw' END AS name, event_id % 3 <> 0 AS reachable, event_id AS uptime_s, concat(event_id // 3600, 'h ', event_id % 3600 // 60, 'm') AS uptime FROM events WHERE event_id % 4 = 2
UNION ALL SELECT event_id, 2, NULL, false, NULL, NULL FROM events WHERE event_id % 4 = 2""")
def _(v):
    return met.snmp_rows(met.parse_metrics(v("metric_snapshots"), "snmp"))


_THRESHOLDS = {0: 0.3, 1: 0.45, 2: 0.3, 3: 0.7}


@query("flt1_filter_confidence", "SELECT det_id FROM detections WHERE confidence >= CASE class_id WHEN 0 THEN 0.3 WHEN 1 THEN 0.45 WHEN 2 THEN 0.3 WHEN 3 THEN 0.7 ELSE 0.6 END", ("detections",))
def _(v):
    t = v.spark.createDataFrame(list(_THRESHOLDS.items()), "class_id int, threshold double")
    return flt.filter_confidence(v("detections"), t).select("det_id")


@query("flt2_filter_min_size", "SELECT det_id FROM detections WHERE bbox_width * 300 >= 20 AND bbox_height * 300 >= 20", ("detections",))
def _(v):
    return flt.filter_min_size(v("detections"), 20, 300, 300).select("det_id")


@query("flt3_filter_classes", "SELECT det_id, class_id FROM detections WHERE class_id IN (0, 1, 3)", ("detections",))
def _(v):
    return flt.filter_classes(v("detections")).select("det_id", "class_id")


@query("flt4_filter_ocr_size", "SELECT det_id FROM detections WHERE NOT (class_id = 3 AND det_id % 6000 < 3000)", ("detections",))
def _(v):
    return flt.filter_ocr_size(v("detections").withColumn("size", F.expr("det_id % 6000"))).select("det_id")


@query("flt5_filter_roi", "SELECT det_id FROM detections WHERE roi_name <> ''", ("detections",))
def _(v):
    return flt.filter_roi(v("detections"), True).select("det_id")


@query("flt6_eligible_devices", "SELECT id, CASE default_token WHEN 'tok_a' THEN uri_a ELSE uri_b END AS uri FROM devices WHERE (source_type = 'file' OR is_online) AND CASE default_token WHEN 'tok_a' THEN uri_a ELSE uri_b END IS NOT NULL", ("devices",))
def _(v):
    return flt.eligible_devices(devices(v)).select("id", "uri")


def patrols(v):
    blocks = F.create_map(F.lit("wed"), F.array(F.array("block_start", "block_end")))
    none = F.create_map().cast("map<string,array<array<string>>>")
    presets = F.transform(F.sequence(F.lit(1), "n_presets"), lambda k: F.concat(F.lit("p"), k))
    return v("patrols").withColumns({"schedule": F.when(F.col("block_start").isNotNull(), blocks).otherwise(none), "preset_order": presets})


_ON = "(valid_from IS NULL OR valid_from <= '2024-01-10') AND (valid_until IS NULL OR valid_until >= '2024-01-10') AND (block_start IS NULL OR (block_start <= '12:00' AND '12:00' < block_end))"


@query("flt7_in_schedule", f"SELECT patrol_id, {_ON} AS due FROM patrols", ("patrols",))
def _(v):
    return patrols(v).select("patrol_id", flt.in_schedule("2024-01-10 12:00").alias("due"))


@query("flt8_prefilter_raw", "SELECT det_id FROM detections WHERE confidence >= 0.25 QUALIFY row_number() OVER (PARTITION BY source_id, frame_num ORDER BY confidence DESC, det_id) <= 2", ("detections",))
def _(v):
    return flt.prefilter_raw(v("detections"), 0.25, 2).select("det_id")


@query("flt9_search", "SELECT id, name FROM devices WHERE site_id = 1 AND (contains(lower(name), '0001') OR contains(lower(host), '10.0.3'))", ("devices",))
def _(v):
    return flt.search(v("devices"), "0001", ("name",), site_id=1).select("id", "name").unionByName(flt.search(v("devices"), "10.0.3", ("host",), site_id=1).select("id", "name")).distinct()


@query("flt10_with_motion", "SELECT event_id, event_id % 3 = 0 AS motion FROM events")
def _(v):
    return flt.with_motion(v("events").selectExpr("event_id", "if(event_id % 3 = 0, 'channels[0]=0 VideoMotion', null) AS status")).select("event_id", "motion")


@query("flt11_runnable_patrols", f"SELECT min(patrol_id) AS patrol_id, p.device_id FROM patrols p JOIN devices d ON d.id = p.device_id WHERE is_active AND is_online AND username <> '' AND ptz AND {_ON} GROUP BY p.device_id", ("patrols", "devices"))
def _(v):
    return flt.runnable_patrols(patrols(v), v("devices"), "2024-01-10 12:00").select("patrol_id", "device_id")


@query("flt12_pending_ocr", "SELECT det_id FROM event_detections WHERE class_id = 3 AND det_id % 5 = 0", ("event_detections",))
def _(v):
    return flt.pending_ocr(v("event_detections")).select("det_id")
