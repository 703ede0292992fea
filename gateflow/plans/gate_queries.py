"""Queries of joins, aggregates, windows and newest rows over detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import joins as jn
from ..operators import topk
from ..operators import windows as win
from ..sources import parsers as src
from .registry import query
from .scalar_queries import shapes


@query("jn1_map_sources", "SELECT det_id, CASE WHEN source_id = 0 THEN 1 ELSE -1 END AS device_id FROM detections", ("detections",))
def _(v):
    return jn.map_sources(v("detections"), src.parse_source_map(v("source_map"))[0]).select("det_id", "device_id")


@query("jn2_require_device", "SELECT det_id, device_id <= 2 AS known FROM detections", ("detections",))
def _(v):
    good, bad = jn.require_device(v("detections"), v("devices").where("id <= 2"))
    return good.select("det_id", F.lit(True).alias("known")).unionByName(bad.select("det_id", F.lit(False).alias("known")))


_IN_BOX = "c.source_id = t.source_id AND c.frame_num = t.frame_num AND c.bbox_left + c.bbox_width / 2 BETWEEN t.bbox_left AND t.bbox_left + t.bbox_width AND c.bbox_top + c.bbox_height / 2 BETWEEN t.bbox_top AND t.bbox_top + t.bbox_height"


@query("jn3_contain_first", f"SELECT det_id, min(truck_det) AS truck_det FROM cargo c JOIN trucks t ON {_IN_BOX} GROUP BY det_id", ("cargo", "trucks"))
def _(v):
    return jn.contain_join(v("cargo"), v("trucks")).select("det_id", "truck_det")


@query("jn3_contain_all", f"SELECT det_id, truck_det FROM cargo c JOIN trucks t ON {_IN_BOX}", ("cargo", "trucks"))
def _(v):
    return jn.contain_join(v("cargo"), v("trucks"), "all").select("det_id", "truck_det")


@query("jn4_roi_join", """
SELECT det_id, coalesce(CASE WHEN cx > x0 AND cx < x0 + w AND cy > y0 AND cy < y0 + h AND has_shapes THEN preset_name END, '') AS roi_name
FROM (SELECT det_id, device_id, bbox_left + bbox_width / 2 AS cx, bbox_top + bbox_height / 2 AS cy FROM detections) d
LEFT JOIN (SELECT * FROM presets QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY preset_id DESC) = 1) p USING (device_id)""", ("detections", "presets"))
def _(v):
    return jn.roi_join(v("detections"), shapes(v)).select("det_id", "roi_name")


@query("jn5_resolve_preset", """
SELECT s_suppkey AS id, coalesce(o.preset_id, f.preset_id) AS preset_id FROM supplier s
LEFT JOIN presets o ON o.device_id = 1 + s_suppkey % 4 AND o.preset_token = concat('p', s_suppkey % 25) AND o.has_shapes AND o.preset_id % 9 <> 4
LEFT JOIN presets f ON f.device_id = 1 + s_suppkey % 4 AND f.preset_id % 9 = 4 AND f.has_shapes AND f.preset_id < 9""", ("presets",))
def _(v):
    p = shapes(v).withColumn("preset_token", F.expr("if(preset_id % 9 = 4, if(preset_id < 9, '__fixed__', 'other'), preset_token)"))
    d = v("supplier").selectExpr("s_suppkey AS id", "cast(1 + s_suppkey % 4 AS int) AS device_id", "concat('p', s_suppkey % 25) AS active_token")
    return jn.resolve_preset(d, p).select("id", "preset_id")


@query("jn6_prev_event", """
SELECT e.event_id, CASE WHEN e.start_ms - p.end_ms <= 30000 THEN p.event_id END AS prev_event_id, CASE WHEN e.start_ms - p.end_ms <= 30000 THEN e.start_ms - p.end_ms END AS gap_ms
FROM closed_events e LEFT JOIN LATERAL (SELECT event_id, end_ms FROM closed_events c WHERE c.site_id = e.site_id AND c.end_ms < e.start_ms ORDER BY end_ms DESC, event_id DESC LIMIT 1) p ON true""", ("closed_events",))
def _(v):
    return jn.prev_event(v("closed_events"))


_OPEN = "SELECT det_id, max_by(event_id, (start_ms, event_id)) AS open_event_id FROM detections d LEFT JOIN closed_events e ON e.site_id = d.site_id AND e.start_ms <= d.ts_ms AND e.start_ms >= d.ts_ms - {0} GROUP BY det_id"


@query("jn7_open_event_at", _OPEN.format(15000), ("detections", "closed_events"))
def _(v):
    return jn.open_event_at(v("detections"), v("closed_events")).select("det_id", "open_event_id")


@query("jn7_open_event_at_3s", _OPEN.format(3000), ("detections", "closed_events"))
def _(v):
    return jn.open_event_at(v("detections"), v("closed_events"), 3000).select("det_id", "open_event_id")


@query("jn8_event_detail", "SELECT det_id, e.event_id, e.start_ms, ts_ms FROM closed_events e JOIN event_detections d USING (event_id) WHERE event_id = 10000001", ("closed_events", "event_detections"))
def _(v):
    return jn.event_detail(v("closed_events"), v("event_detections"), 10000001).select("det_id", "event_id", "start_ms", "ts_ms")


@query("jn9_events_with", "SELECT event_id FROM closed_events WHERE event_id IN (SELECT event_id FROM event_detections WHERE roi_name = 'salida')", ("closed_events", "event_detections"))
def _(v):
    return jn.events_with(v("closed_events"), v("event_detections"), "roi_name = 'salida'").select("event_id")


_DISTANCE = "sqrt(power(1.5 * least(abs(a.h - b.h), 1 - abs(a.h - b.h)), 2) + power(a.s - b.s, 2) + power(0.5 * (a.v - b.v), 2))"


@query("jn10_distinct_clusters", f"""
WITH c AS (SELECT event_id, class_id AS cluster, avg(color_h) AS h, avg(color_s) AS s, avg(color_v) AS v, count(color_h) AS n FROM event_detections GROUP BY ALL),
k AS (SELECT * FROM c WHERE n >= 2)
SELECT event_id, max(coalesce(far, false)) AS splittable FROM (SELECT DISTINCT event_id FROM c) LEFT JOIN (SELECT a.event_id, {_DISTANCE} > 0.25 AS far FROM k a JOIN k b ON a.event_id = b.event_id AND a.cluster < b.cluster) USING (event_id) GROUP BY event_id""", ("event_detections",))
def _(v):
    d = v("event_detections").withColumn("cluster", F.col("class_id"))
    return jn.distinct_clusters(agg.avg_color(d, ("event_id", "cluster")))


@query("jn11_presets_with_snapshot", "SELECT preset_id, CASE WHEN preset_id % 3 = 0 THEN concat('Preset ', preset_token) ELSE preset_name END AS preset_name, CASE WHEN preset_id % 2 = 0 THEN concat('s', preset_id) ELSE '' END AS snapshot FROM presets", ("presets",))
def _(v):
    p = v("presets")
    stored = p.where("preset_id % 2 = 0").withColumn("snapshot", F.concat(F.lit("s"), "preset_id"))
    return jn.presets_with_snapshot(p.withColumn("preset_name", F.expr("if(preset_id % 3 = 0, '', preset_name)")), stored).select("preset_id", "preset_name", "snapshot")


@query("jn17_pair_score", """
WITH RECURSIVE p AS (
 SELECT a.source_id, a.class_id, a.frame_num, b.det_id, a.det_id AS prev_det, greatest(0, least(a.bbox_left + a.bbox_width, b.bbox_left + b.bbox_width) - greatest(a.bbox_left, b.bbox_left)) * greatest(0, least(a.bbox_top + a.bbox_height, b.bbox_top + b.bbox_height) - greatest(a.bbox_top, b.bbox_top)) AS i,
  a.bbox_width * a.bbox_height AS x, b.bbox_width * b.bbox_height AS y FROM detections a JOIN detections b ON b.source_id = a.source_id AND b.class_id = a.class_id AND b.frame_num = a.frame_num + 1),
s AS (SELECT *, round(0.6 * i / (x + y - i) + 0.4 * least(x, y) / greatest(x, y), 9) AS score FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id, class_id, frame_num ORDER BY score DESC, det_id, prev_det) AS n FROM s),
g(source_id, class_id, frame_num, n, det_id, prev_det, score, a, b, free) AS (
 SELECT DISTINCT source_id, class_id, frame_num, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, []::BIGINT[], []::BIGINT[], false FROM k
 UNION ALL
 SELECT source_id, class_id, frame_num, n, det_id, prev_det, score, CASE WHEN free THEN list_append(a, det_id) ELSE a END, CASE WHEN free THEN list_append(b, prev_det) ELSE b END, free FROM (
  SELECT k.*, g.a, g.b, NOT list_contains(g.a, k.det_id) AND NOT list_contains(g.b, k.prev_det) AS free FROM g JOIN k ON k.source_id = g.source_id AND k.class_id = g.class_id AND k.frame_num = g.frame_num AND k.n = g.n + 1))
SELECT det_id, prev_det, score FROM g WHERE free""", ("detections",))
def _(v):
    return jn.pair_score(v("detections"))


_VOTE = """
CASE WHEN a > b THEN 'con_sello' WHEN b > a THEN 'sin_sello' ELSE 'indeterminado' END AS seal_status,
CASE WHEN a + b = 0 THEN 0.0 WHEN a = b THEN 0.5 ELSE greatest(a, b) / (a + b) END AS seal_confidence"""


@query("agg1_seal_vote", f"SELECT event_id, a AS n_sealed, b AS n_unsealed, {_VOTE} FROM (SELECT event_id, count(*) FILTER (class_id = 0) AS a, count(*) FILTER (class_id = 1) AS b FROM event_detections GROUP BY event_id)", ("event_detections",))
def _(v):
    return agg.seal_vote(v("event_detections"))


@query("agg2_avg_color", "SELECT event_id, count(color_h) AS n_colored, CASE WHEN count(color_h) >= 2 THEN round(avg(color_h), 9) END AS color_h, CASE WHEN count(color_h) >= 2 THEN round(avg(color_s), 9) END AS color_s, CASE WHEN count(color_h) >= 2 THEN round(avg(color_v), 9) END AS color_v FROM event_detections GROUP BY event_id", ("event_detections",))
def _(v):
    return agg.avg_color(v("event_detections")).select("event_id", "n_colored", *(F.round(f"color_{c}", 9).alias(f"color_{c}") for c in "hsv"))


@query("agg3_code_consensus", """
WITH d AS (SELECT * FROM event_detections WHERE class_id = 3 AND ocr_processed QUALIFY count(*) OVER (PARTITION BY event_id) >= 2),
c AS (SELECT event_id, ts_ms, det_id, 0 AS k, 'CSQU3054383' AS code FROM d WHERE det_id % 3 = 0 UNION ALL SELECT event_id, ts_ms, det_id, 1, upper(split_part(ocr_text, ' ', 2)) FROM d WHERE ocr_confidence >= 0.6)
SELECT event_id, code AS container_code, count(*) AS n FROM c WHERE code IN ('CSQU3054383', 'MSCU6639870') GROUP BY event_id, code
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, max((ts_ms, det_id)) DESC, min(k)) = 1""", ("event_detections",))
def _(v):
    d = v("event_detections").withColumn("full_text", F.expr("if(det_id % 3 = 0, 'zz csqu3054383', 'none')"))
    return agg.code_consensus(d)


@query("agg4_fps_per_source", "SELECT source_id, ts_ms // 1000 * 1000 AS window_ms, count(*) AS n, count(*)::INT AS fps FROM frames GROUP BY ALL", ("frames",))
def _(v):
    return agg.fps_per_source(v("frames"))


@query("agg10_event_summary", "SELECT event_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n, string_agg(DISTINCT source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) AS cameras, string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR) AS classes FROM event_detections GROUP BY event_id", ("event_detections",))
def _(v):
    return agg.event_summary(v("event_detections"))


@query("agg11_image_hsv", """
WITH c AS (SELECT image, r / 255.0e0 AS r, g / 255.0e0 AS g, b / 255.0e0 AS b, greatest(r, g, b) / 255.0e0 AS m, (greatest(r, g, b) / 255.0e0 - least(r, g, b) / 255.0e0) AS d FROM pixels),
k AS (SELECT image, d / m AS s, m AS v, CASE WHEN b = m THEN (r - g) / d + 4 WHEN g = m THEN (b - r) / d + 2 ELSE (g - b) / d END / 6 AS h FROM c WHERE m > 0.15 AND m < 0.95 AND d > 0.02)
SELECT image, count(h) AS n, CASE WHEN count(h) >= 50 THEN round(avg(CASE WHEN h < 0 THEN h + 1 ELSE h END), 9) END AS h, CASE WHEN count(h) >= 50 THEN round(avg(s), 9) END AS s, CASE WHEN count(h) >= 50 THEN round(avg(v), 9) END AS v
FROM (SELECT DISTINCT image FROM pixels) LEFT JOIN k USING (image) GROUP BY image""", ("pixels",))
def _(v):
    return agg.image_hsv(v("pixels"), 50).select("image", "n", *(F.round(c, 9).alias(c) for c in "hsv"))


@query("agg12_best_crop", "SELECT device_id, object_id, ts_ms // 10000 * 10000 AS window_ms, arg_max(det_id, (confidence, -det_id)) AS det_id, max(confidence) AS confidence FROM detections GROUP BY ALL", ("detections",))
def _(v):
    return agg.best_crop(v("detections"))


@query("agg13_overcrowding", "SELECT source_id, frame_num, 'all' AS roi_name, count(*) AS n FROM detections GROUP BY source_id, frame_num HAVING count(*) > 2", ("detections",))
def _(v):
    return agg.overcrowding(v("detections").withColumn("roi_name", F.lit("all")), 2)


@query("agg15_frame_flags", """
WITH r AS (SELECT source_id, frame_num, roi_name, bool_or(class_id = 4 AND det_id % 3 = 0) AS crossed, count(*) AS c FROM detections GROUP BY ALL)
SELECT source_id, frame_num, bool_or(roi_name <> '') AS any_roi, bool_or(roi_name = 'salida') AS any_exit, bool_or(crossed) AS any_crossing, bool_or(roi_name <> '' AND c > 1) AS crowded FROM r GROUP BY source_id, frame_num""", ("detections",))
def _(v):
    return agg.frame_flags(v("detections").withColumn("crossed", F.expr("class_id = 4 and det_id % 3 = 0")), 1)


CLUSTERS = """
WITH g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w > CASE WHEN lag(source_id) OVER w <> source_id THEN 5000 ELSE 3000 END THEN 1 ELSE 0 END AS new FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY ts_ms, det_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY ts_ms, det_id) AS cluster FROM g),
k AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY {key}, cluster) >= 3)"""


@query("win1_gap_clusters", CLUSTERS.format(table="event_detections", key="site_id") + " SELECT det_id, cluster::BIGINT AS cluster FROM k QUALIFY min(cluster) OVER (PARTITION BY site_id) < max(cluster) OVER (PARTITION BY site_id)", ("event_detections",))
def _(v):
    return win.lane_clusters(v("event_detections")).select("det_id", "cluster")


@query("seal_verdict_per_pass", CLUSTERS.format(table="detections", key="site_id") + f" SELECT site_id, cluster::BIGINT AS cluster, a AS n_sealed, b AS n_unsealed, {_VOTE} FROM (SELECT site_id, cluster, count(*) FILTER (class_id = 0) AS a, count(*) FILTER (class_id = 1) AS b FROM k GROUP BY ALL)", ("detections",))
def _(v):
    from ..operators.events import seal_verdict_per_pass

    return seal_verdict_per_pass(v("detections"))


@query("win2_latest", "SELECT device_id, max_by(det_id, (ts_ms, det_id)) AS det_id, max(ts_ms) AS ts_ms FROM detections GROUP BY device_id", ("detections",))
def _(v):
    return win.latest(v("detections").select("device_id", "det_id", "ts_ms"), ("device_id",), ("ts_ms", "det_id"))


@query("win3_recent_color", "SELECT det_id, CASE WHEN count(color_h) OVER w >= 2 THEN round(avg(color_h) OVER w, 9) END AS recent_h FROM event_detections WINDOW w AS (PARTITION BY event_id ORDER BY ts_ms, det_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)", ("event_detections",))
def _(v):
    return win.recent_color(v("event_detections")).select("det_id", F.round("recent_h", 9).alias("recent_h"))


@query("win4_motion_delta", "SELECT det_id, ts_ms - lag(ts_ms) OVER w AS gap_ms, round(sqrt(power(cx - lag(cx) OVER w, 2) + power(cy - lag(cy) OVER w, 2)), 9) AS jump FROM (SELECT *, bbox_left + bbox_width / 2 AS cx, bbox_top + bbox_height / 2 AS cy FROM event_detections) WINDOW w AS (PARTITION BY event_id ORDER BY ts_ms, det_id)", ("event_detections",))
def _(v):
    return win.motion_delta(v("event_detections")).select("det_id", "gap_ms", F.round("jump", 9).alias("jump"))


def _gate(strict):
    return f"""
WITH c AS (SELECT source_id, truck_id, min(ts_ms) AS cross_ms FROM truck_analytics WHERE crossed GROUP BY ALL),
r AS (SELECT a.source_id, a.truck_id, min(ts_ms) AS roi_ms FROM truck_analytics a {"JOIN c ON c.source_id = a.source_id AND c.truck_id = a.truck_id AND ts_ms >= cross_ms" if strict else ""} WHERE in_roi GROUP BY ALL)
SELECT source_id, truck_id, cross_ms, roi_ms, cross_ms IS NOT NULL AND (roi_ms IS NULL OR roi_ms >= cross_ms) AS active FROM c {"LEFT" if strict else "FULL"} JOIN r USING (source_id, truck_id)"""


@query("win10_truck_gate", _gate(True), ("truck_analytics",))
def _(v):
    return win.truck_gate(v("truck_analytics"))


@query("win10_truck_gate_loose", _gate(False), ("truck_analytics",))
def _(v):
    return win.truck_gate(v("truck_analytics"), strict=False)


@query("win11_line_crossings", """
WITH t AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM tracks WINDOW w AS (PARTITION BY source_id, object_id ORDER BY ts_ms, det_id)),
s AS (SELECT *, 0.8e0 * (py - 0.3e0) - 0.1e0 * (px - 0.1e0) AS b, 0.8e0 * (cy - 0.3e0) - 0.1e0 * (cx - 0.1e0) AS a, (cx - px) * (0.3e0 - py) - (cy - py) * (0.1e0 - px) AS m, (cx - px) * (0.4e0 - py) - (cy - py) * (0.9e0 - px) AS n FROM t WHERE px IS NOT NULL AND source_id = 0)
SELECT source_id, object_id, det_id, 'gate' AS line_name, CASE WHEN b > 0 THEN 'left_to_right' ELSE 'right_to_left' END AS direction FROM s WHERE b * a < 0 AND m * n <= 0""", ("tracks",))
def _(v):
    line = v.spark.createDataFrame([(0, "gate", 0.1, 0.3, 0.9, 0.4)], "source_id int, line_name string, x1 double, y1 double, x2 double, y2 double")
    return win.line_crossings(v("tracks"), line)


def jumps_sql(rows: str, keys: str, gap: str) -> str:
    """CTE ``t``: of ``rows`` (keys, ts_ms, ...) of each key the first, then always the first after ``gap``."""
    on = " AND ".join(f"{{0}}.{k.strip()} = {{1}}.{k.strip()}" for k in keys.split(","))
    return f"""
n AS (SELECT b.*, x.ts_ms AS next_ms FROM {rows} b ASOF LEFT JOIN {rows} x ON {on.format('b', 'x')} AND b.ts_ms + {gap} x.ts_ms),
t AS (SELECT * FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ts_ms) = 1) UNION ALL SELECT n.* FROM t JOIN n ON {on.format('n', 't')} AND n.ts_ms = t.next_ms)"""


@query("win12_throttle", f"""
WITH RECURSIVE f AS (SELECT source_id, ts_ms, det_id FROM detections QUALIFY row_number() OVER (PARTITION BY source_id, frame_num ORDER BY det_id) <= 6),
r AS (SELECT source_id, ts_ms, min(det_id) AS det_id FROM f GROUP BY ALL), {jumps_sql('r', 'source_id', '1000 <=')}
SELECT source_id, ts_ms, det_id FROM t""", ("detections",))
def _(v):
    return win.throttle(v("detections"), ("source_id",), 1000, per_frame=6)


@query("top1_recent_events", "SELECT event_id, code, ts_ms FROM camera_events WHERE device_id = 7 ORDER BY ts_ms DESC, event_id DESC LIMIT 100", ("camera_events",))
def _(v):
    return topk.recent_events(v("camera_events"), 7).select("event_id", "code", "ts_ms")


@query("top2_page", "SELECT event_id, start_ms, (SELECT count(*) FROM closed_events) AS total FROM closed_events ORDER BY start_ms DESC, event_id DESC LIMIT 25 OFFSET 25", ("closed_events",))
def _(v):
    return topk.page(v("closed_events"), 2).select("event_id", "start_ms", "total")


@query("top3_tail_series", "SELECT id, created_ms FROM metric_snapshots WHERE source = 'system' ORDER BY created_ms DESC LIMIT 60", ("metric_snapshots",))
def _(v):
    return topk.tail_series(v("metric_snapshots"), "system").select("id", "created_ms")


@query("top4_overlay_rows", "SELECT det_id, ts_ms FROM detections WHERE source_id = 1 AND ts_ms BETWEEN 297000 AND 300000 ORDER BY ts_ms DESC, det_id DESC LIMIT 100", ("detections",))
def _(v):
    return topk.overlay_rows(v("detections"), 300000, 1).select("det_id", "ts_ms")


@query("top5_default_order", "SELECT event_id, start_ms FROM closed_events", ("closed_events",))
def _(v):
    return topk.in_default_order(v("closed_events"), "events").select("event_id", "start_ms")


@query("top_confident_per_class", "SELECT class_id, det_id FROM detections QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY confidence DESC, det_id) <= 5", ("detections",))
def _(v):
    return flt.prefilter_raw(v("detections").withColumn("frame_num", F.col("class_id")).withColumn("source_id", F.lit(0)), 0.0, 5).select("class_id", "det_id")
