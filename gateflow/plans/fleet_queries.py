"""Queries over devices, sites, operators, instances and metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as met
from ..operators import aggregates as agg
from ..operators import joins as jn
from ..operators import topk
from ..operators import windows as win
from ..operators.nearest import match_embeddings
from .registry import query
from .scalar_queries import devices, patrols


@query("jn12_site_roster", """
SELECT s.site_id, site_name, coalesce(l.n, 0) AS n_levels, coalesce(o.n, 0) AS n_operators, coalesce(o.names, '') AS operators FROM sites s
LEFT JOIN (SELECT site_id, count(*) AS n FROM levels GROUP BY 1) l USING (site_id) LEFT JOIN (SELECT site_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM operators GROUP BY 1) o USING (site_id)""", ("sites", "levels", "operators"))
def _(v):
    return jn.site_roster(v("sites"), v("levels"), v("operators"))


@query("jn13_replace_rules", """
SELECT device_id, idx::BIGINT AS idx, name FROM rules WHERE device_id NOT IN (SELECT device_id FROM new_rules)
UNION ALL SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY ord) - 1, name FROM new_rules""", ("rules", "new_rules"))
def _(v):
    return jn.replace_rules(v("rules"), v("new_rules").where("true"))


@query("jn14_changed_devices", """
SELECT d.id FROM devices d LEFT JOIN old_devices o ON o.id = d.id WHERE o.id IS NULL OR o.host <> d.host OR o.port <> d.port OR o.username <> d.username OR o.password <> d.password OR o.uri_a IS DISTINCT FROM d.uri_a OR o.uri_b IS DISTINCT FROM d.uri_b""", ("devices", "old_devices"))
def _(v):
    return jn.changed_devices(devices(v, "old_devices"), devices(v))


_BOUNDS = """
WITH t AS (SELECT *, coalesce(sum(timeout_s) OVER w, 0) AS from_s, coalesce(min(timeout_s) OVER w, 1) AS shortest FROM levels WINDOW w AS (PARTITION BY site_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT site_id, level, from_s::BIGINT AS from_s, CASE WHEN timeout_s > 0 THEN (from_s + timeout_s)::BIGINT END AS to_s FROM t WHERE shortest > 0)"""


@query("win9_level_bounds", _BOUNDS + " SELECT * FROM b", ("levels",))
def _(v):
    return win.level_bounds(v("levels"))


@query("jn15_escalate", _BOUNDS + " SELECT incident_id, b.level, operator_id FROM incidents i JOIN b ON b.site_id = i.site_id AND age_s >= from_s AND (to_s IS NULL OR age_s < to_s) JOIN operators o ON o.site_id = b.site_id AND o.level = b.level", ("levels", "incidents", "operators"))
def _(v):
    return jn.escalate(v("incidents"), win.level_bounds(v("levels")), v("operators")).select("incident_id", "level", "operator_id")


_PAIRS = """
WITH g AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT p.vec_id, g.vec_id AS match_id, list_cosine_similarity(p.e, g.e) AS cosine FROM g p JOIN g ON g.vec_id <> p.vec_id WHERE p.vec_id % 50 = 0)"""


@query("jn16_match_embeddings", _PAIRS + " SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC) AS place, match_id, round(cosine, 6) AS cosine FROM p QUALIFY place <= 3")
def _(v):
    """The three nearest of every 50th vector, of all others."""
    e = v("vectors")
    place = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("cosine"), "match_id")).cast("long")
    return match_embeddings(e.where("vec_id % 50 = 0"), e, 3).select("vec_id", place.alias("place"), "match_id", F.round("cosine", 6).alias("cosine"))


@query("jn16_match_embeddings_all", _PAIRS + " SELECT vec_id, arg_max(match_id, cosine) AS match_id, round(max(cosine), 6) AS cosine FROM p GROUP BY vec_id")
def _(v):
    """Every 50th vector against all others."""
    e = v("vectors")
    return match_embeddings(e.where("vec_id % 50 = 0"), e).select("vec_id", "match_id", F.round("cosine", 6).alias("cosine"))


@query("jn18_upsert", "SELECT coalesce(o.id, d.id) AS id, CASE WHEN d.id % 2 = 0 THEN d.host ELSE o.host END AS host, o.name AS name FROM old_devices o FULL JOIN (SELECT * FROM devices WHERE id % 2 = 0) d ON d.id = o.id", ("old_devices", "devices"))
def _(v):
    return jn.upsert(v("old_devices").select("id", "host", "name"), v("devices").where("id % 2 = 0"), ["id"], ["host"]).select("id", "host", "name")


@query("jn19_active_preset_name", "SELECT s_suppkey AS id, coalesce(preset_name, '') AS preset_name FROM supplier LEFT JOIN presets ON device_id = 1 + s_suppkey % 4 AND preset_id = s_suppkey % 25", ("presets",))
def _(v):
    d = v("supplier").selectExpr("s_suppkey AS id", "cast(1 + s_suppkey % 4 AS int) AS device_id", "concat('p', s_suppkey % 25) AS active_token")
    return jn.active_preset_name(d, v("presets")).select("id", "preset_name")


@query("agg5_fps_rollup", "SELECT pipeline, coalesce(sum(fps), 0)::BIGINT AS total_fps, count(fps) AS source_count, coalesce(round_even(avg(fps), 1), 0) AS avg_fps FROM pipelines LEFT JOIN source_fps USING (pipeline) GROUP BY pipeline", ("pipelines", "source_fps"))
def _(v):
    return agg.fps_rollup(v("source_fps"), v("pipelines"))


@query("agg6_container_rollup", """
SELECT pipeline, instance, round(sum(CASE WHEN running THEN cpu ELSE 0 END), 4) AS cpu, sum(CASE WHEN running THEN pids ELSE 0 END)::BIGINT AS pids, count(*) FILTER (running) AS n_running, count(DISTINCT instance) AS n_instances, grouping(pipeline, instance)::BIGINT AS level,
 CASE WHEN count(*) FILTER (running) > 0 THEN 'running' ELSE 'stopped' END AS state FROM containers GROUP BY GROUPING SETS ((pipeline, instance), (pipeline))""", ("containers",))
def _(v):
    return agg.container_rollup(v("containers")).select("pipeline", "instance", F.round("cpu", 4).alias("cpu"), "pids", "n_running", "n_instances", "level", "state")


@query("agg7_stream_kpis", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS online, 2 AS total, 3 AS readers, event_id % 5 + 1 AS lost, 2.5e0 AS jitter FROM events WHERE event_id % 4 = 1")
def _(v):
    return met.stream_kpis(met.parse_metrics(v("metric_snapshots"), "mediamtx"))


@query("agg8_system_kpis", "SELECT event_id AS id, cast(event_id % 100 AS double) AS cpu, 1.5e0 AS load, cast(event_id % 90 AS double) AS ram, CASE WHEN event_id % 3 = 0 THEN 20.0 ELSE 10.0 END AS disk_pct, CASE WHEN event_id % 3 = 0 THEN 7.0 ELSE 5.0 END AS disk_free, CASE WHEN event_id % 8 = 0 THEN cast(event_id % 70 AS double) END AS gpu_util, CASE WHEN event_id % 8 = 0 THEN 1838.0e0 / 4096 * 100 END AS gpu_mem_pct FROM events WHERE event_id % 4 = 0")
def _(v):
    return met.system_kpis(met.parse_metrics(v("metric_snapshots"), "system"))


@query("agg9_pipeline_kpis", "SELECT event_id AS id, cast(event_id % 60 AS double) AS fps, 2.0e0 AS sources, 1 AS running, 2 AS instances, cast(event_id % 50 AS double) AS cpu, 440.5e0 AS mem, 3.0e0 AS net, 9.0e0 AS pids FROM events WHERE event_id % 4 = 3")
def _(v):
    return met.pipeline_kpis(met.parse_metrics(v("metric_snapshots"), "deepstream"))


@query("agg14_pivot_series", "SELECT tick, sum(fps) FILTER (pipeline = 'pipe0')::BIGINT AS pipe0, sum(fps) FILTER (pipeline = 'pipe1')::BIGINT AS pipe1, sum(fps) FILTER (pipeline = 'pipe9')::BIGINT AS pipe9 FROM source_fps GROUP BY tick", ("source_fps",))
def _(v):
    return agg.pivot_series(v("source_fps"), ["pipe0", "pipe1", "pipe9"])


@query("agg16_outcome_tally", "SELECT count(*) FILTER (username <> '' AND is_online) AS n_ok, count(*) FILTER (username = '') AS n_skipped, count(*) FILTER (username <> '' AND NOT is_online) AS n_error FROM devices", ("devices",))
def _(v):
    return agg.outcome_tally(v("devices").withColumn("ok", F.col("is_online")))


@query("win5_prune", "SELECT id, source FROM metric_snapshots QUALIFY row_number() OVER (PARTITION BY source ORDER BY created_ms DESC, id DESC) <= 200", ("metric_snapshots",))
def _(v):
    return win.prune(v("metric_snapshots")).select("id", "source")


@query("win6_assign_instances", """
SELECT id, pipeline, (k % n + 1)::INT AS instance, (k // n)::INT AS source_id FROM (SELECT id, pipeline, row_number() OVER (PARTITION BY pipeline ORDER BY host, id) - 1 AS k, least(greatest(ceil(count(*) OVER (PARTITION BY pipeline) / 4), 1), 4)::BIGINT AS n FROM devices)""", ("devices",))
def _(v):
    return win.assign_instances(v("devices"))


@query("win7_device_health", """
WITH r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY device_id ORDER BY cycle) AS run FROM pings),
f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY device_id, run ORDER BY cycle) AS fails FROM r),
s AS (SELECT *, fails < 3 AS is_online, lag(fails < 3) OVER (PARTITION BY device_id ORDER BY cycle) AS before FROM f)
SELECT device_id, cycle, fails::INT AS failure_count, is_online, coalesce(before <> is_online, false) AS changed, CASE WHEN NOT is_online THEN min(cycle) FILTER (fails >= 3) OVER (PARTITION BY device_id, run) END AS offline_since FROM s""", ("pings",))
def _(v):
    return win.device_health(v("pings"))


@query("win8_watchdog_runs", """
WITH r AS (SELECT *, sum((fps >= 6)::INT) OVER (PARTITION BY device_id ORDER BY cycle) AS run FROM fps),
c AS (SELECT *, sum((fps = 0)::INT) OVER w AS z, sum((fps BETWEEN 1 AND 5)::INT) OVER w AS l FROM r WINDOW w AS (PARTITION BY device_id, run ORDER BY cycle))
SELECT device_id, cycle, CASE WHEN fps = 0 THEN 'zero' ELSE 'low' END AS reason FROM c WHERE (fps = 0 AND z % 12 = 0) OR (fps BETWEEN 1 AND 5 AND l % 18 = 0)""", ("fps",))
def _(v):
    return win.watchdog_runs(v("fps"))


def watchdog_sql(rows: str) -> str:
    """CTE ``w``: counters of bad cycles over ``rows`` (device_id, i, cycle, fps), a device's i going up from 1. A counter lives 180 s."""
    return f"""
w(device_id, i, cycle, reason, zc, zb, lc, lb, pending, until) AS (
  SELECT DISTINCT device_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, -1::BIGINT FROM {rows}
  UNION ALL
  SELECT device_id, i, cycle, hit, CASE WHEN fps >= 6 OR hit = 'zero' THEN 0 WHEN fps = 0 THEN z ELSE zc END, CASE WHEN fps >= 6 OR hit = 'zero' THEN 0 WHEN fps = 0 AND z = 1 THEN s ELSE zb END,
    CASE WHEN fps >= 6 OR hit = 'low' THEN 0 WHEN fps > 0 THEN l ELSE lc END, CASE WHEN fps >= 6 OR hit = 'low' THEN 0 WHEN fps > 0 AND l = 1 THEN s ELSE lb END,
    until > s, CASE WHEN hit IS NOT NULL THEN s + 3600 ELSE until END
  FROM (SELECT *, CASE WHEN fps = 0 AND z >= 12 THEN 'zero' WHEN fps BETWEEN 1 AND 5 AND l >= 18 THEN 'low' END AS hit FROM (
    SELECT r.device_id, r.i, r.cycle, r.fps, r.cycle * 10 AS s, zc, zb, lc, lb, until, 1 + CASE WHEN zc > 0 AND r.cycle * 10 - zb < 180 THEN zc ELSE 0 END AS z, 1 + CASE WHEN lc > 0 AND r.cycle * 10 - lb < 180 THEN lc ELSE 0 END AS l
    FROM w JOIN {rows} r ON r.device_id = w.device_id AND r.i = w.i + 1)))"""


@query("win8_fps_watchdog", f"WITH RECURSIVE f AS (SELECT *, cycle AS i FROM fps), {watchdog_sql('f')} SELECT device_id, cycle, reason FROM w WHERE reason IS NOT NULL", ("fps",))
def _(v):
    return win.fps_watchdog(v("fps"))


@query("win13_patrol_plan", "SELECT patrol_id, t AS at_s, concat('p', 1 + (t // dwell_s) % n_presets) AS preset FROM patrols, range(0, 61) r(t) WHERE t % dwell_s = 0", ("patrols",))
def _(v):
    return win.patrol_plan(patrols(v))


@query("win14_session_starts", """
WITH g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 30000 THEN 0 ELSE 1 END AS new FROM viewers WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n FROM s GROUP BY user_id, k""", ("viewers",))
def _(v):
    return win.session_starts(v("viewers"))


@query("set1_all_sources", "SELECT id, name, source_type FROM devices WHERE source_type = 'file' OR is_online", ("devices",))
def _(v):
    return topk.all_sources(v("devices"))


@query("set2_all_sessions", """
SELECT event_id AS id, 'abcdefghijkl' AS session, event_id % 5 AS lost, 2.5e0 AS jitter FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 'short', 1, 0 FROM events WHERE event_id % 4 = 1""")
def _(v):
    return met.flatten_sessions(met.parse_metrics(v("metric_snapshots"), "mediamtx"))
