"""Queries of event construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from .gate_queries import _DISTANCE, _VOTE, CLUSTERS, jumps_sql
from .registry import query


#: Detections in pieces between pauses of more than 15 s, numbered in each; then the open events of a piece row by row: of each
#: its start, id, last ten rows, and when a seal and the exit were last seen.
ASSIGN = """
d AS (SELECT site_id, det_id, ts_ms, source_id, class_id, roi_name, bbox_left + bbox_width / 2 AS cx, bbox_top + bbox_height / 2 AS cy, color_h, color_s, color_v, ts_ms - lag(ts_ms) OVER w AS gap FROM detections WINDOW w AS (PARTITION BY site_id ORDER BY ts_ms, det_id)),
p AS (SELECT *, sum(CASE WHEN gap <= 15000 THEN 0 ELSE 1 END) OVER (PARTITION BY site_id ORDER BY ts_ms, det_id) AS piece FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY site_id, piece ORDER BY ts_ms, det_id) AS n, {'ts': ts_ms, 'source': source_id, 'x': cx, 'y': cy, 'h': color_h, 's': color_s, 'v': color_v} AS r FROM p),
fold(site_id, piece, n, det_id, event_id, open) AS (
  SELECT DISTINCT site_id, piece, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::STRUCT("start" BIGINT, id BIGINT, rows STRUCT(ts BIGINT, source INT, x DOUBLE, y DOUBLE, h DOUBLE, s DOUBLE, v DOUBLE)[], seal BIGINT, exit BIGINT)[] FROM k
  UNION ALL
  SELECT site_id, piece, n, det_id, CASE WHEN fresh THEN det_id ELSE e.id END, CASE
    WHEN fresh THEN list_append(live, {'start': ts_ms, 'id': det_id, 'rows': [r], 'seal': CASE WHEN class_id IN (0, 1) THEN ts_ms END, 'exit': CASE WHEN roi_name = 'salida' THEN ts_ms END})
    ELSE list_transform(live, lambda o: CASE WHEN o.id = e.id THEN {'start': e.start, 'id': e.id, 'rows': list_append(list_slice(e.rows, greatest(len(e.rows) - 8, 1), len(e.rows)), r), 'seal': CASE WHEN class_id IN (0, 1) THEN ts_ms ELSE e.seal END, 'exit': CASE WHEN roi_name = 'salida' THEN ts_ms ELSE e.exit END} ELSE o END) END
  FROM (
    SELECT *, e IS NULL OR (late AND (differs OR sqrt(power(cx - last.x, 2) + power(cy - last.y, 2)) > 0.3)) OR (differs AND ts_ms - last.ts > 1000) AS fresh FROM (
      SELECT *, ts_ms - last.ts > CASE WHEN source_id <> last.source THEN 5000 ELSE 3000 END AS late,
        coalesce(len(known) >= 2 AND sqrt(power(1.5 * least(abs(color_h - list_avg(list_transform(known, lambda c: c.h))), 1 - abs(color_h - list_avg(list_transform(known, lambda c: c.h)))), 2) + power(color_s - list_avg(list_transform(known, lambda c: c.s)), 2) + power(0.5 * (color_v - list_avg(list_transform(known, lambda c: c.v))), 2)) > 0.25, false) AS differs
      FROM (
        SELECT *, e.rows[len(e.rows)] AS last, list_filter(e.rows, lambda c: c.h IS NOT NULL) AS known FROM (
          SELECT *, list_sort(list_filter(live, lambda o: o.start >= ts_ms - 15000), 'DESC')[1] AS e FROM (
            SELECT k.*, list_filter(open, lambda o: least(o.rows[len(o.rows)].ts + 15000, coalesce(o.seal + 3000, 1000000000000000), coalesce(o.exit + 2000, 1000000000000000)) >= k.ts_ms) AS live
            FROM fold JOIN k ON k.site_id = fold.site_id AND k.piece = fold.piece AND k.n = fold.n + 1)))))
)"""


@query("evt1_assign_events", f"WITH RECURSIVE {ASSIGN} SELECT det_id, event_id FROM fold WHERE n > 0", ("detections",))
def _(v):
    return ev.assign_events(v("detections"))


@query("evt1b_assign_events_fast", """
WITH g AS (SELECT *, bbox_left + bbox_width / 2 AS cx, bbox_top + bbox_height / 2 AS cy, ts_ms - lag(ts_ms) OVER w AS gap, lag(source_id) OVER w <> source_id AS crossed,
  CASE WHEN count(color_h) OVER p >= 2 THEN avg(color_h) OVER p END AS ph, CASE WHEN count(color_h) OVER p >= 2 THEN avg(color_s) OVER p END AS ps, CASE WHEN count(color_h) OVER p >= 2 THEN avg(color_v) OVER p END AS pv
  FROM detections WINDOW w AS (PARTITION BY site_id ORDER BY ts_ms, det_id), p AS (PARTITION BY site_id ORDER BY ts_ms, det_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, sqrt(power(cx - lag(cx) OVER w, 2) + power(cy - lag(cy) OVER w, 2)) > 0.3 AS jumped, gap > CASE WHEN crossed THEN 5000 ELSE 3000 END AS late,
  coalesce(sqrt(power(1.5 * least(abs(color_h - ph), 1 - abs(color_h - ph)), 2) + power(color_s - ps, 2) + power(0.5 * (color_v - pv), 2)) > 0.25, false) AS differs FROM g WINDOW w AS (PARTITION BY site_id ORDER BY ts_ms, det_id))
SELECT det_id, last_value(CASE WHEN gap IS NULL OR (late AND (differs OR jumped)) OR (differs AND gap > 1000) OR gap > 15000 THEN det_id END IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts_ms, det_id) AS event_id FROM k""", ("detections",))
def _(v):
    return ev.assign_events_fast(v("detections"))


_CLOSE = """
SELECT event_id, min(due) AS close_ms FROM (
 SELECT event_id, CASE WHEN coalesce(lead(ts_ms) OVER w - ts_ms, 1e12) > 15000 THEN ts_ms + 15000 END AS due FROM event_detections WINDOW w AS (PARTITION BY event_id ORDER BY ts_ms, det_id)
 UNION ALL SELECT event_id, CASE WHEN coalesce(lead(ts_ms) OVER w - ts_ms, 1e12) > 3000 THEN ts_ms + 3000 END FROM event_detections WHERE class_id IN (0, 1) WINDOW w AS (PARTITION BY event_id ORDER BY ts_ms, det_id)
 UNION ALL SELECT event_id, CASE WHEN coalesce(lead(ts_ms) OVER w - ts_ms, 1e12) > 2000 THEN ts_ms + 2000 END FROM event_detections WHERE roi_name = 'salida' WINDOW w AS (PARTITION BY event_id ORDER BY ts_ms, det_id)) GROUP BY event_id"""


@query("evt2_close_times", _CLOSE, ("event_detections",))
def _(v):
    return ev.close_times(v("event_detections"))


@query("evt2_close_times_tick", f"SELECT event_id, (ceil(close_ms / 5000) * 5000)::BIGINT AS close_ms FROM ({_CLOSE})", ("event_detections",))
def _(v):
    return ev.close_times(v("event_detections"), 5000)


@query("evt3_close_on_cross", """
SELECT event_id, min(ts_ms) AS end_ms FROM (SELECT det_id, d.ts_ms, max_by(event_id, (start_ms, event_id)) AS event_id FROM detections d JOIN closed_events e ON e.site_id = d.site_id AND e.start_ms BETWEEN d.ts_ms - 15000 AND d.ts_ms WHERE class_id = 4 AND det_id % 3 = 0 GROUP BY ALL) GROUP BY event_id""", ("detections", "closed_events"))
def _(v):
    return ev.close_on_cross(v("closed_events"), v("detections").where("class_id = 4 and det_id % 3 = 0"))


def _wide(v):
    """Events long and varied enough to split: two hundred detections each."""
    return v("event_detections").withColumn("event_id", F.expr("site_id * 10000000 + cast(floor(det_id / 200) AS bigint)"))


@query("evt4_split_events", CLUSTERS.format(table="(SELECT * REPLACE (site_id * 10000000 + cast(floor(det_id / 200) AS bigint) AS event_id) FROM event_detections)", key="event_id") + f""",
u AS (SELECT * FROM k QUALIFY min(cluster) OVER (PARTITION BY event_id) < max(cluster) OVER (PARTITION BY event_id)),
a AS (SELECT event_id, cluster, avg(color_h) AS h, avg(color_s) AS s, avg(color_v) AS v FROM u GROUP BY ALL HAVING count(color_h) >= 2),
f AS (SELECT DISTINCT a.event_id FROM a JOIN a b ON a.event_id = b.event_id AND a.cluster < b.cluster WHERE {_DISTANCE} > 0.25),
m AS (SELECT det_id, dense_rank() OVER (PARTITION BY event_id ORDER BY cluster) AS part FROM u SEMI JOIN f USING (event_id))
SELECT det_id, coalesce(part, 1)::INT AS part FROM event_detections LEFT JOIN m USING (det_id)""", ("event_detections",))
def _(v):
    from pyspark.sql import Window as W

    s = ev.split_events(_wide(v)).join(v("event_detections").select("det_id", "ts_ms"), "det_id")
    first = s.groupBy("event_id", "new_event_id").agg(F.min(F.struct("ts_ms", "det_id")).alias("f"))
    rank = F.when(F.col("event_id") == F.col("new_event_id"), 1).otherwise(1 + F.sum((F.col("event_id") != F.col("new_event_id")).cast("int")).over(W.partitionBy("event_id").orderBy("f")))
    parts = first.withColumn("part", rank.cast("int")).select("event_id", "new_event_id", "part")
    return s.join(parts, ["event_id", "new_event_id"]).select("det_id", "part")


def merge_sql(detections: str) -> str:
    """CTEs from ``detections`` (with event_id) to ``merged`` (event_id, merged_into). Events of a site in pieces after which all
    had ended for more than 30 s, then those that can still take another, one by one."""
    return f"""
e AS (SELECT event_id, min(site_id) AS site_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(color_h) AS n_colored, coalesce(avg(color_h), 0) AS h, coalesce(avg(color_s), 0) AS s, coalesce(avg(color_v), 0) AS v FROM {detections} GROUP BY event_id),
ep AS (SELECT *, sum(CASE WHEN start_ms - top <= 30000 THEN 0 ELSE 1 END) OVER (PARTITION BY site_id ORDER BY start_ms, event_id) AS piece FROM (SELECT *, max(end_ms) OVER (PARTITION BY site_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)),
en AS (SELECT *, row_number() OVER (PARTITION BY site_id, piece ORDER BY start_ms, event_id) AS i FROM ep),
joined(site_id, piece, i, event_id, merged_into, kept) AS (
  SELECT DISTINCT site_id, piece, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::STRUCT("end" BIGINT, id BIGINT, n BIGINT, h DOUBLE, s DOUBLE, v DOUBLE)[] FROM en
  UNION ALL
  SELECT site_id, piece, i, event_id, CASE WHEN ok THEN p.id ELSE event_id END, CASE
    WHEN ok THEN list_transform(near, lambda o: CASE WHEN o.id = p.id THEN {{'end': greatest(p."end", end_ms), 'id': p.id, 'n': p.n + n_colored, 'h': p.h + n_colored * h, 's': p.s + n_colored * s, 'v': p.v + n_colored * v}} ELSE o END)
    ELSE list_append(near, {{'end': end_ms, 'id': event_id, 'n': n_colored, 'h': n_colored * h, 's': n_colored * s, 'v': n_colored * v}}) END
  FROM (
    SELECT *, coalesce(n_colored >= 2 AND p.n >= 2 AND sqrt(power(1.5 * least(abs(h - p.h / p.n), 1 - abs(h - p.h / p.n)), 2) + power(s - p.s / p.n, 2) + power(0.5 * (v - p.v / p.n), 2)) <= 0.2, false) AS ok FROM (
      SELECT *, list_sort(list_filter(near, lambda o: o."end" < start_ms), 'DESC')[1] AS p FROM (
        SELECT en.*, list_filter(kept, lambda o: en.start_ms - o."end" <= 30000) AS near FROM joined JOIN en ON en.site_id = joined.site_id AND en.piece = joined.piece AND en.i = joined.i + 1)))
),
merged AS (SELECT event_id, merged_into FROM joined WHERE i > 0)"""


@query("evt5_merge_events", f"WITH RECURSIVE {merge_sql('event_detections')} SELECT * FROM merged", ("event_detections",))
def _(v):
    return ev.merge_events(ev.colors_of(v("event_detections")))


_WIDE = "(SELECT * REPLACE (site_id * 10000000 + cast(floor(det_id / 200) AS bigint) AS event_id) FROM event_detections)"


@query("evt6_finalize", "WITH RECURSIVE " + CLUSTERS.format(table=_WIDE, key="event_id").strip().removeprefix("WITH ") + f""",
u AS (SELECT * FROM k QUALIFY min(cluster) OVER (PARTITION BY event_id) < max(cluster) OVER (PARTITION BY event_id)),
a AS (SELECT event_id, cluster, avg(color_h) AS h, avg(color_s) AS s, avg(color_v) AS v FROM u GROUP BY ALL HAVING count(color_h) >= 2),
f AS (SELECT DISTINCT a.event_id FROM a JOIN a b ON a.event_id = b.event_id AND a.cluster < b.cluster WHERE {_DISTANCE} > 0.25),
m AS (SELECT det_id, -1 - min(det_id) OVER (PARTITION BY event_id, cluster) AS fresh FROM u SEMI JOIN f USING (event_id) QUALIFY dense_rank() OVER (PARTITION BY event_id ORDER BY cluster) > 1),
s AS (SELECT w.* REPLACE (coalesce(fresh, event_id) AS event_id) FROM {_WIDE} w LEFT JOIN m USING (det_id)),
{merge_sql('s')},
votes AS (SELECT event_id, {_VOTE} FROM (SELECT event_id, count(*) FILTER (class_id = 0) AS a, count(*) FILTER (class_id = 1) AS b FROM s GROUP BY event_id)),
t AS (SELECT s.* REPLACE (merged_into AS event_id) FROM s JOIN merged USING (event_id)),
x AS (SELECT * FROM t WHERE class_id = 3 AND ocr_processed QUALIFY count(*) OVER (PARTITION BY event_id) >= 2),
y AS (SELECT event_id, ts_ms, det_id, upper(split_part(ocr_text, ' ', 2)) AS code FROM x WHERE ocr_confidence >= 0.6),
z AS (SELECT event_id, code AS container_code FROM y WHERE code IN ('CSQU3054383', 'MSCU6639870') GROUP BY event_id, code QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, max((ts_ms, det_id)) DESC) = 1)
SELECT t.event_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n, any_value(seal_status) AS seal_status, any_value(seal_confidence) AS seal_confidence, any_value(container_code) AS container_code
FROM t JOIN votes USING (event_id) LEFT JOIN z USING (event_id) GROUP BY t.event_id""", ("event_detections",))
def _(v):
    return ev.finalize(_wide(v))


@query("evt7_open_from_frames", f"WITH RECURSIVE fr AS (SELECT DISTINCT source_id::BIGINT AS lane, ts_ms FROM frames), {jumps_sql('fr', 'lane', '3000 <')} SELECT lane, ts_ms AS start_ms FROM t", ("frames",))
def _(v):
    return ev.open_from_frames(v("frames"))
