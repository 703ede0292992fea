"""Queries that run a stream over the given tables, to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import operators as live
from ..streaming import run
from ..streaming.run import in_order, read_table, run_available, run_complete, run_updates, shared_dir
from ..streaming.upserts import KeyedTable
from .event_queries import ASSIGN
from .fixtures import VIEWS, Views
from .fleet_queries import watchdog_sql
from .gate_queries import jumps_sql
from .registry import query
from .scalar_queries import with_shapes


def ordered(v: Views, name: str, by: str) -> DataFrame:
    """A view as a stream in order of ``by``. One of more rows than a batch may have is written in that order first, once a query,
    so that all streams of a query have the same times in a batch."""
    path = v.__dict__.setdefault("in_order", {}).get(name)
    if path is None:
        v.in_order[name] = path = in_order(v(name), by)
    return read_table(v.spark, path, files_per_trigger=1)


def stream(v: Views, name: str) -> DataFrame:
    """A view over events, as a stream: of detections, or what is made of them, in order of their time."""
    need = VIEWS[name][0]
    views = [x for x in need if x in VIEWS] + [name]
    if "detections" in views and v("events").count() > run.BATCH_ROWS:
        df = ordered(v, "detections", "ts_ms")
        df.createOrReplaceTempView("detections")
        views.remove("detections")
    else:
        read_table(v.spark, f"{v.sf_dir}/events.parquet").createOrReplaceTempView("events")
    for n in views:
        df = v.spark.sql(VIEWS[n][1])
        df.createOrReplaceTempView(n)
    return df


def events_by_id(v: Views) -> DataFrame:
    """Events as a stream in order of their ids."""
    return ordered(v, "events", "event_id") if v("events").count() > run.BATCH_ROWS else read_table(v.spark, f"{v.sf_dir}/events.parquet")


#: The tables' clock starts at 0, which a first watermark counts as late; streams run this much ahead of it.
AHEAD_MS = 1000


def with_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_ms", F.col("ts_ms") + AHEAD_MS).withColumn("ts", F.timestamp_millis("ts_ms"))


def back(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col) - AHEAD_MS)


@query("str1_stream_events", f"""
WITH RECURSIVE {ASSIGN},
a AS (SELECT f.det_id, f.event_id, k.* EXCLUDE (det_id) FROM fold f JOIN k USING (det_id)),
c AS (SELECT site_id, event_id, least(max(ts_ms) + 15000, coalesce(max(ts_ms) FILTER (class_id IN (0, 1)) + 3000, 1000000000000000), coalesce(max(ts_ms) FILTER (roi_name = 'salida') + 2000, 1000000000000000)) AS due FROM a GROUP BY ALL)
SELECT site_id::BIGINT AS lane, 'assign' AS kind, det_id, event_id, ts_ms AS at_ms FROM a
UNION ALL SELECT site_id, 'close', NULL, event_id, due FROM c WHERE due < (SELECT max(ts_ms) FROM a WHERE a.site_id = c.site_id) OR due <= (SELECT max(ts_ms) - 10000 FROM a)""", ("detections",))
def _(v):
    return back(run_available(live.stream_events(with_ts(stream(v, "detections")))), "at_ms")


@query("str2_stream_truck_gate", """
WITH c AS (SELECT source_id, truck_id, min(ts_ms) AS t FROM truck_analytics WHERE crossed GROUP BY ALL)
SELECT source_id::BIGINT AS source_id, truck_id, 'CROSS' AS event, t AS ts_ms FROM c
UNION ALL SELECT a.source_id, a.truck_id, 'ROI_IN', min(ts_ms) FROM truck_analytics a JOIN c ON c.source_id = a.source_id AND c.truck_id = a.truck_id AND (ts_ms, det_id) >= (t, 0) WHERE in_roi GROUP BY a.source_id, a.truck_id""", ("truck_analytics",))
def _(v):
    return back(run_available(live.stream_truck_gate(with_ts(stream(v, "truck_analytics")))), "ts_ms")


@query("str3_stream_health", """
WITH p AS (SELECT user_id % 50 AS device_id, event_id AS cycle, (event_id * 7) % 10 < 4 AS ok FROM events),
r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY device_id ORDER BY cycle) AS run FROM p),
f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY device_id, run ORDER BY cycle) < 3 AS is_online FROM r),
s AS (SELECT *, coalesce(lag(is_online) OVER (PARTITION BY device_id ORDER BY cycle), true) AS was FROM f)
SELECT device_id, cycle, is_online, CASE WHEN NOT is_online THEN cycle END AS offline_since FROM s WHERE is_online <> was""")
def _(v):
    events = events_by_id(v)
    return run_available(live.stream_health(events.selectExpr("user_id % 50 AS device_id", "event_id AS cycle", "(event_id * 7) % 10 < 4 AS ok"), ttl_ms=None))


@query("str4_stream_watchdog", f"""
WITH RECURSIVE f AS (SELECT user_id % 3 AS device_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS i, event_id AS cycle, CASE event_id // 600 % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 10 END AS fps FROM events), {watchdog_sql('f')}
SELECT device_id, cycle, reason, pending FROM w WHERE reason IS NOT NULL""")
def _(v):
    events = events_by_id(v)
    fps = "cast(CASE WHEN cast(floor(event_id / 600) AS bigint) % 3 = 0 THEN 0 WHEN cast(floor(event_id / 600) AS bigint) % 3 = 1 THEN 3 ELSE 10 + event_id % 20 END AS int)"
    return run_available(live.stream_watchdog(events.selectExpr("user_id % 3 AS device_id", "event_id AS cycle", f"{fps} AS fps"), ttl_ms=None))


@query("str5_stream_fps", "SELECT source_id, ts_ms // 1000 * 1000 AS window_ms, count(*) AS n, count(*)::INT AS fps FROM detections GROUP BY ALL", ("detections",))
def _(v):
    return back(run_updates(live.stream_fps(with_ts(stream(v, "detections"))), ("source_id", "window_ms")), "window_ms")


def as_of_sql(facts: str, changes: str, key: str, row: str) -> str:
    """``facts`` with ``c``: the newest row of ``changes`` of the same ``key`` at or before its time; null if there is none."""
    return f"""
newest AS (SELECT f.{row}, max_by(c, (c.ts_ms, c.number)) AS c FROM {facts} f JOIN {changes} c ON c.{key} IS NOT DISTINCT FROM f.{key} AND c.ts_ms <= f.ts_ms GROUP BY f.{row}),
f AS (SELECT f.*, newest.c FROM {facts} f LEFT JOIN newest USING ({row}))"""


@query("str6_stream_map", f"WITH {as_of_sql('detections', 'map_changes', 'source_id', 'det_id')} SELECT det_id, coalesce(c.device_id, -1) AS device_id FROM f", ("detections", "map_changes"))
def _(v):
    return run_available(live.stream_map(stream(v, "detections"), stream(v, "map_changes"), forget_ms=None).select("det_id", "device_id"))


@query("str7_preset_filter", f"""
WITH {as_of_sql('preset_events', 'preset_changes', 'device_id', 'event_id')},
t AS (SELECT *, CASE WHEN ts_ms - c.ts_ms < 120000 AND c.active_token <> '__fixed__' THEN c.active_token END AS token FROM f)
SELECT event_id, CASE WHEN token IS NULL THEN 'p0_a;p1_a' ELSE concat(token, '_a') END AS roi,
  CASE WHEN token IS NULL OR starts_with(direction, concat(token, '_')) THEN direction ELSE '' END AS direction, CASE WHEN token IS NULL THEN 2 ELSE 1 END AS n_analytics FROM t""", ("preset_events", "preset_changes"))
def _(v):
    e = stream(v, "preset_events").selectExpr("*", "array('p0_a', 'p1_a') AS roi", "array('p0_l') AS lc", "array('p1_o') AS oc", "map('p0_a', '1', 'p1_a', '2') AS analytics")
    out = live.stream_preset_filter(e, stream(v, "preset_changes"), forget_ms=None)
    return run_available(out.select("event_id", F.array_join("roi", ";").alias("roi"), "direction", F.size("analytics").alias("n_analytics")))


@query("str8_stream_throttle", f"WITH RECURSIVE r AS (SELECT source_id::BIGINT AS source_id, ts_ms, min(det_id) AS det_id FROM detections GROUP BY ALL), {jumps_sql('r', 'source_id', '1000 <=')} SELECT source_id, det_id, ts_ms FROM t", ("detections",))
def _(v):
    return back(run_available(live.stream_throttle(with_ts(stream(v, "detections")), ["source_id"], 1000)), "ts_ms")


@query("str9_stream_roi", f"""
WITH {as_of_sql('detections', 'shape_changes', 'device_id', 'det_id')},
p AS (SELECT det_id, bbox_left + bbox_width / 2 AS cx, bbox_top + bbox_height / 2 AS cy, c FROM f)
SELECT det_id, coalesce(CASE WHEN cx > c.x0 AND cx < c.x0 + c.w AND cy > c.y0 AND cy < c.y0 + c.h AND c.has_shapes THEN c.preset_name END, '') AS roi_name FROM p""", ("detections", "shape_changes"))
def _(v):
    changes = with_shapes(stream(v, "shape_changes")).select("device_id", "ts_ms", "number", "shapes")
    return run_available(live.stream_roi(stream(v, "detections"), changes, forget_ms=None).select("det_id", "roi_name"))


@query("str10_stream_cooldown", f"WITH RECURSIVE r AS (SELECT object_id, ts_ms, min(det_id) AS det_id FROM detections GROUP BY ALL), {jumps_sql('r', 'object_id', '30000 <=')} SELECT object_id, det_id, ts_ms FROM t", ("detections",))
def _(v):
    return back(run_available(live.stream_cooldown(with_ts(stream(v, "detections")))), "ts_ms")


@query("str11_stream_consensus", """
WITH d AS (SELECT * FROM event_detections WHERE class_id = 3 AND ocr_processed QUALIFY count(*) OVER (PARTITION BY event_id) >= 2),
c AS (SELECT event_id, ts_ms, det_id, upper(split_part(ocr_text, ' ', 2)) AS code FROM d WHERE ocr_confidence >= 0.6)
SELECT event_id, code AS container_code, count(*) AS n FROM c WHERE code IN ('CSQU3054383', 'MSCU6639870') AND event_id IN (SELECT event_id FROM d WHERE det_id % 2 = 0) GROUP BY event_id, code
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, max((ts_ms, det_id)) DESC) = 1""", ("event_detections",))
def _(v):
    """Five batches, so that events are touched again and again; the table holds each once."""
    root = f"{shared_dir(v.spark)}/consensus-{uuid.uuid4().hex}"
    recognised = v("event_detections").where("class_id = 3 and ocr_processed and det_id % 2 = 0")
    recognised.repartition(5).write.parquet(f"{root}/in")
    table = KeyedTable(f"{root}/codes", ("event_id",), live.CONSENSUS)
    save = live.consensus_batch(lambda: v("event_detections").withColumn("full_text", F.lit("")), table)
    q = read_table(v.spark, f"{root}/in", files_per_trigger=1).writeStream.foreachBatch(save).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read(v.spark)


@query("str12_stream_sessions", """
WITH g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 30000 THEN 0 ELSE 1 END AS new FROM viewers WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n FROM s GROUP BY user_id, k""", ("viewers",))
def _(v):
    rows = with_ts(stream(v, "viewers"))
    return back(back(run_complete(live.stream_sessions(rows)), "start_ms"), "last_ms")


@query("snk3_live_sink", "SELECT device_id::VARCHAR AS key, det_id, source_id, ts_ms FROM detections", ("detections",))
def _(v):
    from ..sources.sinks import live_sink

    root = f"{shared_dir(v.spark)}/live-{uuid.uuid4().hex}"
    live_sink(stream(v, "detections").select("det_id", "device_id", "source_id", "ts_ms"), f"{root}/out", f"{root}/log").awaitTermination()
    rows = v.spark.read.schema("value string, key string").json(f"{root}/out").select("key", F.from_json("value", "det_id long, source_id int, ts_ms long").alias("m"))
    return rows.select("key", "m.*")
