"""Input views derived from the given tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DETECTIONS = """
SELECT e.event_id AS det_id,
  cast(1 + e.user_id % 2 AS int) AS site_id,
  cast(1 + 2 * (e.user_id % 2) + cast(floor(e.event_id / 3) AS bigint) % 2 AS int) AS device_id,
  cast(cast(floor(e.event_id / 3) AS bigint) % 2 AS int) AS source_id,
  CASE e.event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS class_id,
  cast(floor(e.event_id / 5) AS bigint) % 40 AS object_id,
  cast(floor(e.event_id / 6) AS bigint) AS frame_num,
  e.event_id * 300 + b * (2000 + (b % 5) * 4500) AS ts_ms,
  cast((e.event_id * 37) % 1000 AS double) / 1000 AS confidence,
  cast((e.event_id * 13) % 100 AS double) / 125 AS bbox_left,
  cast((e.event_id * 29) % 100 AS double) / 125 AS bbox_top,
  cast(5 + e.event_id % 7 AS double) / 100 AS bbox_width,
  cast(5 + e.event_id % 5 AS double) / 100 AS bbox_height,
  CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE cast((b2 * 31 + e.event_id % 3) % 100 AS double) / 100 END AS color_h,
  CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE cast((b2 * 17) % 100 AS double) / 100 END AS color_s,
  CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE cast((b2 * 7) % 100 AS double) / 100 END AS color_v,
  CASE WHEN e.event_type <> 'purchase' THEN '' ELSE concat('x ', CASE b % 4 WHEN 0 THEN 'CSQU3054383' WHEN 1 THEN 'mscu6639870' WHEN 2 THEN 'CSQU3054384' ELSE 'noise' END, ' 22G1') END AS ocr_text,
  cast(50 + e.event_id % 50 AS double) / 100 AS ocr_confidence,
  CASE WHEN e.event_id % 97 = 0 THEN 'salida' WHEN e.event_id % 7 = 0 THEN 'patio' ELSE '' END AS roi_name
FROM (SELECT *, cast(floor(event_id / 25) AS bigint) AS b, cast(floor(event_id / 50) AS bigint) AS b2 FROM events) e
"""

#: name: (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "detections": (("events",), DETECTIONS),
    # bursts of 25 detections are events here, where an operator needs them given
    "event_detections": (("detections",), "SELECT d.*, site_id * 10000000 + cast(floor(det_id / 25) AS bigint) AS event_id, class_id = 3 AND det_id % 5 <> 0 AS ocr_processed FROM detections d"),
    "closed_events": (("event_detections",), "SELECT event_id, site_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n FROM event_detections GROUP BY event_id, site_id"),
    "trucks": (("detections",), "SELECT det_id AS truck_det, source_id, frame_num, object_id AS truck_id, ts_ms, bbox_left * 0.5e0 AS bbox_left, bbox_width + 0.4e0 AS bbox_width, bbox_top * 0.5e0 AS bbox_top, bbox_height + 0.4e0 AS bbox_height FROM detections WHERE class_id = 4"),
    "cargo": (("detections",), "SELECT * FROM detections WHERE class_id <> 4"),
    "truck_analytics": (("detections",), "SELECT source_id, object_id AS truck_id, ts_ms, det_id, det_id % 3 = 0 AS crossed, det_id % 4 = 1 AS in_roi FROM detections WHERE class_id = 4"),
    "source_map": (("supplier",), "SELECT cast(s_suppkey - 1 AS varchar(20)) AS key, cast(s_suppkey AS varchar(40)) AS value FROM supplier WHERE s_suppkey % 5 = 1 UNION ALL SELECT concat(cast(s_suppkey - 1 AS varchar(20)), ':url'), concat('rtsp://h', cast(s_suppkey - 1 AS varchar(20))) FROM supplier UNION ALL SELECT concat(cast(s_suppkey - 1 AS varchar(20)), ':fps'), cast(s_suppkey + 19 AS varchar(40)) FROM supplier"),
    # what changes while detections come: the map of sources, the presets that are active, the shapes of devices
    "map_changes": (("detections",), "SELECT source_id, ts_ms, det_id AS number, CASE WHEN det_id % 120 = 3 THEN NULL ELSE cast(1 + det_id % 7 AS int) END AS device_id FROM detections WHERE det_id % 40 = 3"),
    "preset_changes": (("detections",), "SELECT device_id, ts_ms, det_id AS number, CASE cast(floor(det_id / 150) AS bigint) % 4 WHEN 0 THEN '__fixed__' WHEN 1 THEN 'p0' WHEN 2 THEN 'p1' END AS active_token FROM detections WHERE det_id % 150 = 7"),
    "shape_changes": (("detections",), "SELECT device_id, ts_ms, det_id AS number, concat('zone', cast(det_id AS varchar(20))) AS preset_name, cast(det_id % 5 AS double) / 10 AS x0, cast(det_id % 3 AS double) / 10 AS y0, 0.4e0 AS w, 0.5e0 AS h, det_id % 700 <> 11 AS has_shapes FROM detections WHERE det_id % 100 = 11"),
    "preset_events": (("detections",), "SELECT det_id AS event_id, device_id, ts_ms, CASE det_id % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'p0_in' ELSE 'p1_out' END AS direction FROM detections"),
    "presets": (("supplier",), "SELECT cast(1 + s_suppkey % 4 AS int) AS device_id, concat('p', cast(s_suppkey AS varchar(20))) AS preset_token, s_suppkey AS preset_id, s_name AS preset_name, cast(s_suppkey % 5 AS double) / 10 AS x0, cast(s_suppkey % 3 AS double) / 10 AS y0, 0.4e0 AS w, 0.5e0 AS h, s_suppkey % 7 <> 6 AS has_shapes FROM supplier"),
    "devices": (("supplier",), "SELECT s_suppkey AS id, s_name AS name, concat('10.0.', cast(s_suppkey % 7 AS varchar(9)), '.', cast(s_suppkey AS varchar(9))) AS host, cast(80 + s_suppkey % 2 AS int) AS port, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE concat('u', cast(s_suppkey AS varchar(9))) END AS username, concat('secret', cast(s_suppkey % 13 AS varchar(9))) AS password, cast(1 + s_suppkey % 2 AS int) AS site_id, CASE WHEN s_suppkey % 5 = 0 THEN 'file' ELSE 'rtsp' END AS source_type, s_suppkey % 3 <> 0 AS is_online, concat('pipe', cast(s_suppkey % 4 AS varchar(9))) AS pipeline, CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE concat('rtsp://h', cast(s_suppkey AS varchar(9)), '/a') END AS uri_a, CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE concat('rtsp://h', cast(s_suppkey AS varchar(9)), '/b') END AS uri_b, CASE WHEN s_suppkey % 9 = 2 THEN 'tok_b' ELSE 'tok_a' END AS default_token, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE cast(90 + s_suppkey % 20 AS double) END AS h_fov_wide, s_suppkey % 4 <> 0 AS ptz FROM supplier"),
    "pings": (("events",), "SELECT user_id % 50 AS device_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS cycle, (event_id * 7) % 10 < 4 AS ok FROM events"),
    "fps": (("events",), "SELECT user_id % 50 AS device_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS cycle, cast(CASE WHEN cast(floor(event_id / 600) AS bigint) % 3 = 0 THEN 0 WHEN cast(floor(event_id / 600) AS bigint) % 3 = 1 THEN 3 ELSE 10 + event_id % 20 END AS int) AS fps FROM events"),
    "camera_lines": (("events",), "SELECT event_id AS line_id, user_id % 50 AS device_id, CASE WHEN event_id % 13 = 0 THEN concat('noise ', event_type) WHEN event_id % 5 = 0 THEN concat('Code=', event_type, ';index=', cast(event_id % 4 AS varchar(9))) WHEN event_id % 7 = 0 THEN concat('Code=', event_type, ';action=Stop') ELSE concat('Code=', event_type, ';action=Start;index=', cast(event_id % 4 AS varchar(9)), ';data=', props) END AS line FROM events"),
    "camera_events": (("events",), "SELECT event_id, user_id % 50 AS device_id, event_type AS code, CASE WHEN event_id % 2 = 0 THEN 'Start' ELSE 'Stop' END AS action, event_id * 1000 AS ts_ms FROM events"),
    "frames_json": (("detections",), "SELECT frame_num, min(ts_ms) AS ts_ms, concat('{\"device_id\":', cast(min(device_id) AS varchar(9)), ',\"source_id\":', cast(min(source_id) AS varchar(9)), ',\"frame_num\":', cast(frame_num AS varchar(20)), ',\"timestamp_ms\":', CASE WHEN frame_num % 17 = 0 THEN '0' ELSE cast(min(ts_ms) AS varchar(20)) END, ',\"objects\":[{\"class_id\":', cast(min(class_id) AS varchar(9)), ',\"object_id\":', cast(min(object_id) AS varchar(9)), ',\"truck_id\":', cast(max(object_id) AS varchar(9)), ',\"confidence\":0.5,\"bbox\":{\"left\":0.25,\"top\":0.5,\"width\":0.125,\"height\":0.25}},{\"class_id\":', cast(max(class_id) AS varchar(9)), ',\"object_id\":', cast(max(object_id) AS varchar(9)), ',\"truck_id\":-1,\"confidence\":0.75,\"bbox\":{\"left\":0.5,\"top\":0.5,\"width\":0.125,\"height\":0.25}}]', CASE WHEN frame_num % 19 = 0 THEN '' ELSE '}' END) AS body FROM detections GROUP BY frame_num"),
    "frames_json2": (("detections",), "SELECT frame_num, concat('{\"source_id\":', cast(min(source_id) AS varchar(9)), ',\"frame_num\":', cast(frame_num AS varchar(20)), ',\"ts\":', cast(min(ts_ms) AS varchar(20)), ',\"objects\":[{\"cls\":', cast(min(class_id) AS varchar(9)), ',\"truck\":', cast(max(object_id) AS varchar(9)), ',\"conf\":0.5,\"bbox\":[0.25,0.5,0.125,0.25]}]}') AS body FROM detections GROUP BY frame_num"),
    "truck_json": (("trucks",), "SELECT truck_det, concat('{\"event\":\"', CASE WHEN truck_det % 2 = 0 THEN 'CROSS' ELSE 'ROI_IN' END, '\",\"source_id\":', cast(source_id AS varchar(9)), ',\"truck_id\":', cast(truck_id AS varchar(9)), ',\"timestamp_ms\":', cast(ts_ms AS varchar(20)), ',\"roi_name\":\"r1\",\"cargo\":[', CASE WHEN truck_det % 3 = 0 THEN '' ELSE concat('{\"class_id\":', cast(truck_det % 4 AS varchar(9)), ',\"confidence\":0.5}') END, ']}') AS body FROM trucks"),
    "config_lines": (("supplier",), "SELECT s_suppkey AS device_id, concat('table.VideoAnalyseRule[0][0].Name=rule', cast(s_suppkey AS varchar(9)), chr(10), 'table.VideoAnalyseRule[0][0].Enable=true', chr(10), CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'table.VideoAnalyseRule[0][0].Direction=LeftToRight' END, chr(10), 'table.VideoAnalyseRule[0][1].Type=CrossLineDetection', chr(10), 'bad line', chr(10), 'table.MotionDetect[0].Window[2].Sensitive=', cast(s_suppkey % 9 AS varchar(9))) AS body FROM supplier"),
    "ini_files": (("supplier",), "SELECT s_suppkey AS file_id, concat('# comment', chr(10), '[property]', chr(10), 'enable=1', chr(10), chr(10), '[roi-filtering-stream-', cast(s_suppkey AS varchar(9)), ']', chr(10), 'roi-RF=1;2;', cast(s_suppkey AS varchar(9)), chr(10), 'class-id=', cast(s_suppkey % 4 AS varchar(9)), chr(10), 'class-id=7') AS body FROM supplier"),
    "metric_snapshots": (("events",), "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'mediamtx' WHEN 2 THEN 'snmp' ELSE 'deepstream' END AS source, event_id * 30000 AS created_ms, CASE event_id % 4 WHEN 0 THEN concat('{\"cpu\":{\"percent\":', cast(event_id % 100 AS varchar(9)), ',\"load_1m\":1.5},\"memory\":{\"percent\":', cast(event_id % 90 AS varchar(9)), ',\"used_mb\":100,\"total_mb\":400},\"gpu\":{\"available\":', CASE WHEN event_id % 8 = 0 THEN 'true' ELSE 'false' END, ',\"gpus\":[{\"gpu_utilization_pct\":', cast(event_id % 70 AS varchar(9)), ',\"memory_used_mb\":1838,\"memory_total_mb\":4096,\"temperature_c\":66}]},\"disk\":{\"partitions\":[{\"mountpoint\":\"/data\",\"percent\":10,\"free_gb\":5},{\"mountpoint\":\"', CASE WHEN event_id % 3 = 0 THEN '/' ELSE '/x' END, '\",\"percent\":20,\"free_gb\":7}]}}') WHEN 1 THEN concat('{\"paths\":[{\"name\":\"a\",\"online\":true,\"readers\":[1,2],\"bytes_received\":', cast(event_id * 1000 AS varchar(20)), '},{\"name\":\"b\",\"online\":', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, ',\"readers\":[1]}],\"rtsp_sessions\":[{\"id\":\"abcdefghijklmnop\",\"rtp_packets_lost\":', cast(event_id % 5 AS varchar(9)), ',\"rtp_packets_jitter\":2.5}],\"webrtc_sessions\":[{\"id\":\"short\",\"rtp_packets_lost\":1}]}') WHEN 2 THEN concat('{\"devices\":[{\"id\":1,\"name\":\"', CASE WHEN event_id % 3 = 0 THEN '(none)' ELSE 'sw' END, '\",\"description\":\"d\",\"uptime\":\"', cast(event_id * 100 AS varchar(20)), '\"},{\"id\":2,\"name\":\"\",\"description\":\"\",\"uptime\":\"x\"}]}') ELSE concat('{\"containers\":{\"p1-1\":{\"running\":true,\"cpu_percent\":', cast(event_id % 50 AS varchar(9)), ',\"memory_mb\":440.5,\"network_rx_mb\":3,\"pids\":9},\"p1-2\":{\"running\":false}},\"fps\":{\"p1\":{\"total_fps\":', cast(event_id % 60 AS varchar(9)), ',\"source_count\":2}}}') END AS data FROM events"),
    "frames": (("detections",), "SELECT DISTINCT source_id, frame_num, ts_ms FROM detections"),
    "containers": (("events",), "SELECT event_id AS tick, concat('pipe', cast(event_id % 3 AS varchar(9))) AS pipeline, concat('i', cast(user_id % 4 AS varchar(9))) AS instance, event_id % 4 <> 0 AS running, value AS cpu, value * 2 AS mem, event_id % 30 AS pids, event_id * 1000000 AS mem_bytes, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id * 2000000 END AS mem_limit, event_id % 500 AS cpu_total, event_id % 400 AS cpu_before, event_id % 9000 AS sys_total, event_id % 8000 AS sys_before FROM events"),
    "source_fps": (("events",), "SELECT event_id % 97 AS tick, concat('pipe', cast(user_id % 4 AS varchar(9))) AS pipeline, user_id % 10 AS source_id, cast(event_id % 40 AS int) AS fps FROM events"),
    "pipelines": (("nation",), "SELECT DISTINCT concat('pipe', cast(n_nationkey % 6 AS varchar(9))) AS pipeline FROM nation"),
    "sites": (("region",), "SELECT r_regionkey AS site_id, r_name AS site_name FROM region"),
    "levels": (("supplier",), "SELECT s_suppkey % 5 AS site_id, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS level, CASE WHEN row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey DESC) = 1 THEN 0 ELSE 60 + 10 * (s_suppkey % 25) END AS timeout_s FROM supplier"),
    "operators": (("customer",), "SELECT c_custkey AS operator_id, c_name AS name, c_nationkey % 5 AS site_id, 1 + c_custkey % 5 AS level FROM customer"),
    "incidents": (("orders",), "SELECT o_orderkey AS incident_id, o_orderkey % 5 AS site_id, o_orderkey % 900 AS age_s FROM orders"),
    "viewers": (("events",), "SELECT user_id % 200 AS user_id, event_id * 4000 AS ts_ms FROM events"),
    "patrols": (("supplier",), "SELECT s_suppkey AS patrol_id, 1 + s_suppkey % 60 AS device_id, s_suppkey % 5 <> 0 AS is_active, CASE WHEN s_suppkey % 4 = 0 THEN '2024-01-01' END AS valid_from, CASE WHEN s_suppkey % 6 = 0 THEN '2024-01-09' END AS valid_until, CASE s_suppkey % 3 WHEN 0 THEN '08:00' WHEN 1 THEN '11:00' END AS block_start, CASE s_suppkey % 3 WHEN 0 THEN '12:00' WHEN 1 THEN '18:00' END AS block_end, 1 + s_suppkey % 4 AS n_presets, 5 + s_suppkey % 9 AS dwell_s FROM supplier"),
    "pixels": (("lineitem",), "SELECT l_orderkey % 500 AS image, l_linenumber AS x, cast(l_quantity * 5 AS int) % 256 AS r, cast(floor(l_extendedprice) AS bigint) % 256 AS g, cast(round(l_discount * 2000) + l_quantity AS int) % 256 AS b FROM lineitem"),
    "ocr_regions": (("detections",), "SELECT det_id, 0 AS pos, 'csqu' AS text, cast(55 + det_id % 40 AS double) / 100 AS conf, CASE WHEN det_id % 3 = 0 THEN NULL ELSE cast(det_id % 10 AS double) END AS x FROM detections WHERE class_id = 3 UNION ALL SELECT det_id, 1, '3054383', cast(60 + det_id % 30 AS double) / 100, CASE WHEN det_id % 4 = 0 THEN NULL ELSE cast(det_id % 11 AS double) + 0.5e0 END FROM detections WHERE class_id = 3 UNION ALL SELECT det_id, 2, ' ', 0.9e0, CASE WHEN det_id % 5 = 0 THEN NULL ELSE 20.25e0 END FROM detections WHERE class_id = 3"),
    "old_devices": (("devices",), "SELECT id, name, CASE WHEN id % 5 = 0 THEN '1.1.1.1' ELSE host END AS host, port, username, CASE WHEN id % 17 = 3 THEN 'old' ELSE password END AS password, CASE WHEN id % 11 = 0 THEN NULL ELSE uri_a END AS uri_a, uri_b FROM devices WHERE id % 10 <> 1"),
    "rules": (("supplier",), "SELECT 1 + s_suppkey % 60 AS device_id, s_suppkey % 4 AS idx, concat('r', cast(s_suppkey AS varchar(9))) AS name FROM supplier"),
    "new_rules": (("supplier",), "SELECT 1 + s_suppkey % 20 AS device_id, s_suppkey AS ord, concat('n', cast(s_suppkey AS varchar(9))) AS name FROM supplier"),
    "tracks": (("detections",), "SELECT source_id, object_id, det_id, ts_ms, bbox_left + bbox_width / 2 AS cx, bbox_top + bbox_height / 2 AS cy FROM detections"),
    "vectors": (("embeddings",), "SELECT vec_id, embedding, label FROM embeddings"),
}


def _needs(name: str) -> list[str]:
    """The views that ``name`` is made of, itself last, in order."""
    out: list[str] = []
    for d in VIEWS[name][0] if name in VIEWS else ():
        out += [x for x in _needs(d) if x not in out]
    return [*out, name]


class Views:
    """Views over one data folder, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        for n in _needs(name):
            df = self.spark.sql(VIEWS[n][1]) if n in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet")
            df.createOrReplaceTempView(n)
        return df


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with the views that it reads as common table expressions."""
    made: list[str] = []
    for name in names:
        made += [n for n in _needs(name) if n in VIEWS and n not in made]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in made)
    sql = sql.strip()
    if not ctes:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{sql[len('WITH RECURSIVE'):]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {ctes},\n{sql[len('WITH'):]}"
    return f"WITH {ctes}\n{sql}"
