"""Live operators: events, truck gate, health, watchdog, rates, maps, filters, throttles, consensus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import events as ev
from ..operators import joins as jn
from ..operators.windows import WatchdogCounter, sessions_of
from .dimensions import FORGET_MS, with_live
from .folds import fold
from .upserts import GONE, KeyedTable


def _lane_state(state: dict) -> ev.Lane:
    return ev.Lane(True, [ev.OpenEvent(e["id"], e["start"], [tuple(r[:4]) + (tuple(r[4]) if r[4] else None,) for r in e["recent"]], e["seal"], e["exit"]) for e in state.get("open", [])])


def _keep(state: dict, lane: ev.Lane, seen: int) -> None:
    state.clear()
    if lane.open:
        state.update(seen=seen, open=[{"id": e.event_id, "start": e.start, "recent": e.recent, "seal": e.seal, "exit": e.exit} for e in lane.open])


def stream_events(det: DataFrame, lane: str = "site_id", delay: str = "10 seconds") -> DataFrame:
    """Events of a stream of detections: rows ``assign`` (det_id, event_id, its time), ``close`` (event_id, when), and
    ``late`` for detections older than what their lane has seen, which go to nobody.

    ``det`` has a timestamp column ``ts``. Rows later than ``delay`` behind the stream's newest are dropped by the
    watermark before they get here, so it should be as long as rows are worth telling about. Open events are the state; event-time timers close them at the
    first of their deadlines."""

    def step(state, r):
        state.setdefault("seen", -1)
        if r.ts_ms < state["seen"]:
            return [("late", r.det_id, None, r.ts_ms)]
        lane_now = _lane_state(state)
        out = [("close", None, i, at) for i, _, at in lane_now.close_until(r.ts_ms)]
        color = None if r.color_h is None or r.color_h != r.color_h else (r.color_h, r.color_s, r.color_v)
        event = lane_now.assign(r.det_id, r.ts_ms, r.source_id, r.cx, r.cy, color, r.class_id, r.roi_name)
        _keep(state, lane_now, r.ts_ms)
        return [*out, ("assign", r.det_id, event, r.ts_ms)]

    def due(state):
        return min((e.deadline() for e in _lane_state(state).open), default=None)

    def late(state, now):
        lane_now, seen = _lane_state(state), state.get("seen", now)
        out = [("close", None, i, at) for i, _, at in lane_now.close_until(now + 1)]
        _keep(state, lane_now, seen)
        return out

    narrow = det.withWatermark("ts", delay).select("ts", F.col(lane).cast("long").alias("lane"), "det_id", "ts_ms", "source_id", (F.col("bbox_left") + F.col("bbox_width") / 2).alias("cx"), (F.col("bbox_top") + F.col("bbox_height") / 2).alias("cy"), "color_h", "color_s", "color_v", "class_id", "roi_name")
    return fold(narrow, ["lane"], ["ts_ms", "det_id"], "lane long, kind string, det_id long, event_id long, at_ms long", step, due, late)


def stream_truck_gate(analytics: DataFrame, strict: bool = True, delay: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """First crossing and first entry of each truck as they happen. A truck not seen for an hour is forgotten."""

    def step(state, r):
        out = []
        if r.crossed and state.get("cross") is None:
            state["cross"] = r.ts_ms
            out.append(("CROSS", r.ts_ms))
        if r.in_roi and state.get("roi") is None and (not strict or state.get("cross") is not None):
            state["roi"] = r.ts_ms
            out.append(("ROI_IN", r.ts_ms))
        state["last"] = r.ts_ms
        return out

    def late(state, now):
        state.clear()
        return []

    df = analytics.withWatermark("ts", delay).select("ts", F.col("source_id").cast("long").alias("source_id"), "truck_id", "ts_ms", "det_id", "crossed", "in_roi")
    return fold(df, ["source_id", "truck_id"], ["ts_ms", "det_id"], "source_id long, truck_id long, event string, ts_ms long", step, lambda s: s["last"] + idle_ms, late)


def stream_health(pings: DataFrame, failures: int = 3, ttl_ms: int | None = FORGET_MS) -> DataFrame:
    """Changes of status, with the cycle since when a device is offline. A device is forgotten ``ttl_ms`` after its last ping, a
    day by default; such a stream goes on till it is stopped, so a run over what is there passes None."""

    def step(state, r):
        n = 0 if r.ok else state.get("n", 0) + 1
        state["n"], was = n, state.get("online", True)
        state["online"] = n < failures
        return [(r.cycle, state["online"], None if state["online"] else r.cycle)] if state["online"] != was else []

    return fold(pings.select("device_id", "cycle", "ok"), ["device_id"], ["cycle"], "device_id long, cycle long, is_online boolean, offline_since long", step, ttl_ms=ttl_ms)


def stream_watchdog(fps: DataFrame, cycle_s: int = 10, pending_s: int = 3600, ttl_ms: int | None = FORGET_MS) -> DataFrame:
    """Restart requests, and whether one is pending already; ``ttl_ms`` as in :func:`stream_health`."""

    def step(state, r):
        c = WatchdogCounter(state.get("zero", (0, 0)), state.get("low", (0, 0)))
        at = int(r.cycle) * cycle_s
        hit = c.see(at, int(r.fps))
        pending = state.get("until", -1) > at
        state.update(zero=c.zero, low=c.low)
        if hit:
            state["until"] = at + pending_s
        return [(r.cycle, hit, pending)] if hit else []

    return fold(fps.select("device_id", "cycle", "fps"), ["device_id"], ["cycle"], "device_id long, cycle long, reason string, pending boolean", step, ttl_ms=ttl_ms)


def stream_fps(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Frames per second and source in tumbling windows of one second. In append mode a window is told when the watermark has
    passed it, so the last ones wait for later rows; ``run_updates`` tells them all."""
    g = frames.withWatermark("ts", delay).groupBy(F.window("ts", "1 second"), "source_id").agg(F.count("*").alias("n"))
    return g.select("source_id", F.unix_millis("window.start").alias("window_ms"), "n", F.floor(F.col("n") + 0.5).cast("int").alias("fps"))


def stream_map(det: DataFrame, changes: DataFrame, forget_ms: int | None = FORGET_MS) -> DataFrame:
    """device_id of each source, -1 where unmapped, by the map as it was at the row's time. ``changes`` is a stream of (ts_ms, source_id,
    device_id), with a null device where a source is taken out of the map; see :func:`with_live`."""
    mapped = with_live(det.drop("device_id"), changes, ["source_id"], ["device_id"], forget_ms=forget_ms, **_numbered(changes))
    return mapped.withColumn("device_id", F.coalesce("device_id", F.lit(-1)))


def stream_roi(det: DataFrame, changes: DataFrame, forget_ms: int | None = FORGET_MS) -> DataFrame:
    """Regions of a stream's detections, by the shapes of the device as they were at the row's time. ``changes`` is a stream of (ts_ms,
    device_id, shapes); a device's newest shapes replace those before."""
    shaped = with_live(det, changes, ["device_id"], ["shapes"], forget_ms=forget_ms, **_numbered(changes))
    return jn.roi_of(shaped, "shapes").drop("shapes")


def _numbered(changes: DataFrame) -> dict:
    return {"number": "number"} if "number" in changes.columns else {}


#: An active preset that is not told again for so long counts no more.
PRESET_MS = 120_000


def own_preset(events: DataFrame) -> DataFrame:
    """Keep what belongs to the device's active preset, ``active_token``, which goes.

    Names in ``roi``, ``lc`` and ``oc`` and keys in ``analytics`` must start with the preset's token; a direction that does not
    is blank. Devices without an active preset, or with ``__fixed__``, are left alone."""
    on = F.col("active_token").isNotNull() & (F.col("active_token") != "__fixed__")
    prefix = F.concat("active_token", F.lit("_"))
    mine = lambda c: F.when(on, F.filter(c, lambda n: F.startswith(n, prefix))).otherwise(F.col(c))
    return events.withColumns({
        **{c: mine(c) for c in ("roi", "lc", "oc")},
        "direction": F.when(on & ~F.startswith(F.col("direction"), prefix), "").otherwise(F.col("direction")),
        "analytics": F.when(on, F.map_filter("analytics", lambda k, _: F.startswith(k, prefix))).otherwise(F.col("analytics")),
    }).drop("active_token")


def preset_filter(events: DataFrame, active: DataFrame) -> DataFrame:
    """:func:`own_preset` for a table of events, or a stream of them, and a table of active presets."""
    return own_preset(events.join(active.select("device_id", "active_token"), "device_id", "left"))


def stream_preset_filter(events: DataFrame, changes: DataFrame, ttl_ms: int = PRESET_MS, forget_ms: int | None = FORGET_MS) -> DataFrame:
    """:func:`own_preset` with the preset that was active at the event's time. ``changes`` is a stream of (ts_ms, device_id, active_token); one
    counts for ``ttl_ms``, after which events pass whole until the preset is told again."""
    return own_preset(with_live(events, changes, ["device_id"], ["active_token"], ttl_ms=ttl_ms, forget_ms=forget_ms, **_numbered(changes)))


def stream_sessions(viewers: DataFrame, key: str = "user_id", gap_ms: int = 30_000, delay: str = "10 seconds") -> DataFrame:
    """Sessions of keep-alives of a stream with a timestamp column ``ts``. One is told when the watermark has passed its end, so rows up to
    ``delay`` late still extend it or join two; ``run_complete`` tells all."""
    return sessions_of(viewers.withWatermark("ts", delay), key, "ts", gap_ms)


def stream_throttle(df: DataFrame, keys: list[str], interval_ms: int, delay: str = "10 seconds") -> DataFrame:
    """Of each key at most one row per interval, counted from the last that went through.

    ``df`` has a timestamp column ``ts``; rows later than ``delay`` behind the stream's newest are dropped by the watermark. A key
    is forgotten once the watermark is an interval past its last row, when any row would go through."""

    def step(state, r):
        if "last" in state and r.ts_ms - state["last"] < interval_ms:
            return []
        state["last"] = r.ts_ms
        return [(r.det_id, r.ts_ms)]

    def late(state, now):
        state.clear()
        return []

    df = df.withWatermark("ts", delay).select("ts", *(F.col(k).cast("long").alias(k) for k in keys), "det_id", "ts_ms")
    return fold(df, keys, ["ts_ms", "det_id"], ", ".join([*(f"{k} long" for k in keys), "det_id long", "ts_ms long"]), step, lambda s: s["last"] + interval_ms, late)


def stream_cooldown(df: DataFrame, identity: str = "object_id", interval_ms: int = 30_000, delay: str = "10 seconds") -> DataFrame:
    """An identity once in 30 s, and forgotten after."""
    return stream_throttle(df, [identity], interval_ms, delay)


CONSENSUS = "event_id long, container_code string, n long"


def consensus_batch(read: Callable[[], DataFrame], table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the codes of the events that a batch of recognised detections touches, upserted into ``table``.

    ``read`` gives all detections as they are now; it is asked anew for every batch, as a table of files is listed when it is read. An
    event that has no code any more loses its row. A batch that is run again changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("event_id").distinct()
        codes = agg.code_consensus(read().join(touched, "event_id", "left_semi"))
        table.write(touched.join(codes, "event_id", "left").withColumn(GONE, F.col("container_code").isNull()), batch_id)

    return run
