"""Gaps, runs, retention, assignment and order-dependent folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chains import let_through
from .lanes import SPAN_MS, before_span, fold_rows, running

ORDER = ("ts_ms", "det_id")


def gap_clusters(det: DataFrame, keys: tuple[str, ...] = ("event_id",), gap_ms: int = 3000, cross_ms: int = 5000, least: int = 3, several: bool = True) -> DataFrame:
    """Rows with the number of their cluster: a new one after a gap of more than 3 s, or 5 s where the
    source changes. Clusters of fewer than ``least`` rows are dropped; with ``several`` also keys that have
    one cluster only."""
    w = W.partitionBy(*keys).orderBy(*ORDER)
    limit = F.when(F.lag("source_id").over(w) != F.col("source_id"), cross_ms).otherwise(gap_ms)
    new = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) > limit).cast("int"), F.lit(0))
    c = det.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).drop("_new")
    c = c.withColumn("_n", F.count("*").over(W.partitionBy(*keys, "cluster"))).where(F.col("_n") >= least).drop("_n")
    if not several:
        return c
    every = W.partitionBy(*keys)
    return c.withColumns({"_lo": F.min("cluster").over(every), "_hi": F.max("cluster").over(every)}).where("_lo < _hi").drop("_lo", "_hi")


def lane_clusters(det: DataFrame, lane: str = "site_id", gap_ms: int = 3000, cross_ms: int = 5000, least: int = 3, several: bool = True, span_ms: int = SPAN_MS) -> DataFrame:
    """:func:`gap_clusters` for keys with many rows each: windows over time spans of a lane, joined by what was last before."""
    at = (lane, "_span")
    d = det.withColumn("_span", F.floor(F.col("ts_ms") / span_ms))
    row = F.struct(*ORDER, "source_id")
    d = before_span(d, (lane,), {"_old": F.max(row)}, {"_old": F.max})
    w = W.partitionBy(*at).orderBy(*ORDER)
    d = d.withColumn("_prev", F.coalesce(F.lag(row).over(w), F.col("_old")))
    limit = F.when(F.col("_prev.source_id") != F.col("source_id"), cross_ms).otherwise(gap_ms)
    d = d.withColumn("_new", F.coalesce((F.col("ts_ms") - F.col("_prev.ts_ms") > limit).cast("int"), F.lit(0))).drop("_old", "_prev")
    d = before_span(d, (lane,), {"_cuts": F.sum("_new")}, {"_cuts": F.sum})
    c = d.withColumn("cluster", F.sum("_new").over(w) + F.coalesce("_cuts", F.lit(0))).drop("_new", "_cuts", "_span")
    c = c.withColumn("_n", F.count("*").over(W.partitionBy(lane, "cluster"))).where(F.col("_n") >= least).drop("_n")
    if not several:
        return c
    ends = c.groupBy(F.col(lane).alias("_lane")).agg(F.min("cluster").alias("_lo"), F.max("cluster").alias("_hi")).where("_lo < _hi")
    return c.join(ends, F.col(lane).eqNullSafe(F.col("_lane")), "left_semi")


def latest(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def recent_color(det: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """recent_h, _s, _v: mean colour of the 10 rows before, if two have one."""
    w = W.partitionBy(*keys).orderBy(*ORDER).rowsBetween(-10, -1)
    n = F.count("color_h").over(w)
    return det.withColumns({f"recent_{c}": F.when(n >= 2, F.avg(f"color_{c}").over(w)) for c in "hsv"})


def motion_delta(det: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """gap_ms and jump (of the centre) since the row before."""
    w = W.partitionBy(*keys).orderBy(*ORDER)
    cx, cy = F.col("bbox_left") + F.col("bbox_width") / 2, F.col("bbox_top") + F.col("bbox_height") / 2
    dx, dy = cx - F.lag(cx).over(w), cy - F.lag(cy).over(w)
    return det.withColumns({"gap_ms": F.col("ts_ms") - F.lag("ts_ms").over(w), "jump": F.sqrt(dx * dx + dy * dy)})


def prune(df: DataFrame, n: int = 200, key: str = "source", order: tuple[str, ...] = ("created_ms", "id")) -> DataFrame:
    """The newest ``n`` rows of each key. The rank filter is pushed below the shuffle by Spark."""
    w = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def assign_instances(devices: DataFrame, per_instance: int = 4, max_instances: int = 4) -> DataFrame:
    """Round robin of a pipeline's devices, by (host, id), over as many instances as it needs; the slot inside
    an instance is the source's number."""
    every, line = W.partitionBy("pipeline"), W.partitionBy("pipeline").orderBy("host", "id")
    n, k = F.count("*").over(every), F.row_number().over(line) - 1
    needed = F.least(F.greatest(F.ceil(n / per_instance), F.lit(1)), F.lit(max_instances))
    return devices.withColumns({"_n": needed, "_k": k}).select("id", "pipeline", (F.col("_k") % F.col("_n") + 1).cast("int").alias("instance"), F.floor(F.col("_k") / F.col("_n")).cast("int").alias("source_id"))


#: Cycles of a device in one span: a device with a long history is spread over its spans.
SPAN_CYCLES = 10_000


def device_health(pings: DataFrame, failures: int = 3, span: int = SPAN_CYCLES) -> DataFrame:
    """Status at each ping and the cycle since when a device is offline: after ``failures`` pings without answer.

    All follows from the place of the last answer before a ping and at it, and these are running values (see
    :func:`.lanes.running`), so that a device with half of all pings is no task's alone."""
    key = ("device_id",)
    d = running(pings, key, "cycle", ("cycle",), {"_at": F.lit(1).cast("long")}, span_ms=span)
    d = running(d, key, "cycle", ("cycle",), greatest={"_ok": F.when(F.col("ok"), F.col("_at"))}, span_ms=span)
    count = F.col("_at") - F.coalesce("_ok", F.lit(0))
    # before an answer the run is what it was: the place of the answer before that is needed
    d = d.withColumns({"failure_count": count.cast("int"), "_full": F.when(count == failures, F.struct("_at", "cycle"))})
    ended = F.when(~F.col("ok") & (count >= failures), F.col("_at"))
    d = running(d.withColumn("_off", ended), key, "cycle", ("cycle",), greatest={"_since": F.col("_full"), "_last_off": F.col("_off")}, span_ms=span)
    online = F.col("failure_count") < failures
    # the ping before was offline: by its own place for an answer, by its count for a failure
    was_off = F.when(F.col("ok"), F.coalesce(F.col("_last_off") == F.col("_at") - 1, F.lit(False))).otherwise(F.col("failure_count") > failures)
    changed = (F.col("_at") > 1) & (was_off == online)
    return d.withColumns({"is_online": online, "changed": changed, "offline_since": F.when(~online, F.col("_since.cycle"))}).select(
        *(c for c in pings.columns if c != "ok"), "failure_count", "is_online", "changed", "offline_since"
    )


def watchdog_runs(fps: DataFrame, floor: int = 6, zero_cycles: int = 12, low_cycles: int = 18, span: int = SPAN_CYCLES) -> DataFrame:
    """Set-based watchdog without expiry of counters: between good cycles, zero and low cycles are counted, and
    every full count asks for a restart and begins anew. Counts since the last good cycle are differences of running sums."""
    key, bad = ("device_id",), F.col("fps")
    sums = {"_at": F.lit(1).cast("long"), "_zero": (bad == 0).cast("long"), "_low": ((bad > 0) & (bad < floor)).cast("long")}
    r = running(fps, key, "cycle", ("cycle",), sums, span_ms=span)
    r = running(r, key, "cycle", ("cycle",), greatest={"_good": F.when(bad >= floor, F.struct("_at", "_zero", "_low"))}, span_ms=span)
    n_zero, n_low = (F.col(c) - F.coalesce(f"_good.{c}", F.lit(0)) for c in ("_zero", "_low"))
    restart = ((bad == 0) & (n_zero % zero_cycles == 0)) | (bad.between(1, floor - 1) & (n_low % low_cycles == 0))
    return r.where(restart).select("device_id", "cycle", F.when(bad == 0, "zero").otherwise("low").alias("reason"))


class WatchdogCounter:
    """Counts of bad cycles of one device. A counter lives 180 s from its first hit; a good cycle clears both."""

    def __init__(self, zero=(0, 0), low=(0, 0), floor=6, zero_cycles=12, low_cycles=18, ttl_s=180):
        self.zero, self.low = tuple(zero), tuple(low)
        self.floor, self.zero_cycles, self.low_cycles, self.ttl_s = floor, zero_cycles, low_cycles, ttl_s

    def see(self, at_s: int, fps: int) -> str | None:
        """'zero' or 'low' if this cycle asks for a restart."""
        if fps >= self.floor:
            self.zero = self.low = (0, 0)
            return None
        name, limit = ("zero", self.zero_cycles) if fps == 0 else ("low", self.low_cycles)
        count, born = getattr(self, name)
        if count and at_s - born >= self.ttl_s:
            count = 0
        count, born = count + 1, born if count else at_s
        hit = count >= limit
        setattr(self, name, (0, 0) if hit else (count, born))
        return name if hit else None


def fps_watchdog(fps: DataFrame, cycle_s: int = 10, **limits) -> DataFrame:
    """Restart requests with expiring counters. A good cycle clears them, so bad cycles are folded run by run."""

    def step(counter: WatchdogCounter, key, cycle, v):
        hit = counter.see(cycle * cycle_s, v)
        return [(key[0], cycle, hit)] if hit else []

    good = F.col("fps") >= WatchdogCounter(**limits).floor
    runs = fps.select(F.col("device_id").cast("long").alias("device_id"), F.col("cycle").cast("long").alias("cycle"), "fps")
    runs = running(runs, ("device_id",), "cycle", ("cycle",), {"_run": good.cast("long")}, span_ms=SPAN_CYCLES).where(~good)
    return fold_rows(runs, ("device_id", "_run"), ("cycle",), ("cycle", "fps"), "device_id long, cycle long, reason string", lambda: WatchdogCounter(**limits), step)


def level_bounds(levels: DataFrame) -> DataFrame:
    """(site, level, from_s, to_s): ages at which a level is called; a timeout of 0 makes it the last."""
    w = W.partitionBy("site_id").orderBy("level")
    before = F.coalesce(F.sum("timeout_s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ended = F.coalesce(F.max((F.col("timeout_s") == 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    b = levels.withColumns({"from_s": before, "_over": ended}).where("_over = 0")
    return b.select("site_id", "level", "from_s", F.when(F.col("timeout_s") > 0, F.col("from_s") + F.col("timeout_s")).alias("to_s"))


def truck_gate(analytics: DataFrame, strict: bool = True) -> DataFrame:
    """First crossing and first region entry of each truck; in strict mode entries before the crossing do not count.
    A truck is active from its crossing to its entry."""
    keys = ["source_id", "truck_id"]
    cross = analytics.where("crossed").groupBy(*keys).agg(F.min("ts_ms").alias("cross_ms"))
    if strict:
        entry = analytics.where("in_roi").join(cross, keys).where("ts_ms >= cross_ms").groupBy(*keys).agg(F.min("ts_ms").alias("roi_ms"))
    else:
        entry = analytics.where("in_roi").groupBy(*keys).agg(F.min("ts_ms").alias("roi_ms"))
    out = cross.join(entry, keys, "left" if strict else "full_outer")
    return out.withColumn("active", F.col("cross_ms").isNotNull() & (F.col("roi_ms").isNull() | (F.col("roi_ms") >= F.col("cross_ms"))))


def line_crossings(tracks: DataFrame, lines: DataFrame) -> DataFrame:
    """Crossings of configured lines by consecutive centres of a track, with the side that it came from."""
    w = W.partitionBy("source_id", "object_id").orderBy(*ORDER)
    t = tracks.withColumns({"_px": F.lag("cx").over(w), "_py": F.lag("cy").over(w)}).where("_px is not null")
    j = t.join(lines, "source_id")
    side = lambda x, y: (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    move = lambda x, y: (F.col("cx") - F.col("_px")) * (y - F.col("_py")) - (F.col("cy") - F.col("_py")) * (x - F.col("_px"))
    before, after = side(F.col("_px"), F.col("_py")), side(F.col("cx"), F.col("cy"))
    a, b = move(F.col("x1"), F.col("y1")), move(F.col("x2"), F.col("y2"))
    hit = (before * after < 0) & (a * b <= 0)
    return j.where(hit).select("source_id", "object_id", "det_id", "line_name", F.when(before > 0, "left_to_right").otherwise("right_to_left").alias("direction"))


def throttle(df: DataFrame, keys: tuple[str, ...], interval_ms: int, per_frame: int | None = None) -> DataFrame:
    """Rows that a limiter lets through: of each key one per interval, counted from the last that went through.

    A chain over the rows of a key (see :mod:`.chains`), so a key that never pauses is spread as well; only keys, places and
    successors go to Python."""
    if per_frame:
        w = W.partitionBy("source_id", "frame_num").orderBy("det_id")
        df = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_frame).drop("_r")

    narrow = df.select(*dict.fromkeys([*keys, "ts_ms", "det_id"]))
    return let_through(narrow, keys, "ts_ms", ORDER, interval_ms)


def patrol_plan(patrols: DataFrame, horizon_s: int = 60) -> DataFrame:
    """(patrol, offset, preset): which preset is due when, from now to the horizon."""
    p = patrols.where("size(preset_order) > 0").withColumn("at_s", F.explode(F.sequence(F.lit(0), F.lit(horizon_s), F.col("dwell_s").cast("int"))))
    step = (F.col("at_s") / F.col("dwell_s")).cast("int")
    return p.select("patrol_id", "at_s", F.element_at("preset_order", step % F.size("preset_order") + 1).alias("preset"))


def session_starts(df: DataFrame, key: str = "user_id", gap_ms: int = 30_000) -> DataFrame:
    """Sessions of keep-alives: (key, start, last, n); one begins when none came in the last 30 s. For a stream see
    :func:`gateflow.streaming.operators.stream_sessions`."""
    return sessions_of(df.withColumn("_ts", F.timestamp_millis("ts_ms")), key, "_ts", gap_ms)


def sessions_of(df: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """Session windows over a table or a stream with a watermark: partial sessions are merged before the shuffle and after it."""
    g = df.groupBy(key, F.session_window(ts, f"{gap_ms} milliseconds").alias("w")).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"))
    return g.select(key, "start_ms", "last_ms", "n")
