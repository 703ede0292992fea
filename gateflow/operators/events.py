"""Container events: assignment, closing, splitting, merging, verdicts.

A lane is the unit that events are told apart in (a site by default; one constant lane makes them
global). Exact assignment depends on the events chosen before, so it is a fold over a lane's rows;
``assign_events_fast`` is its set-based form, equal to it while no segment between pauses of 15 s is longer
than 15 s.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import hsv_distance
from .aggregates import avg_color, code_consensus, seal_vote
from .chains import let_through
from .joins import distinct_clusters, open_event_at
from .lanes import cut, fold_rows, number, with_rows_before
from .speculation import speculative_fold
from .windows import gap_clusters, lane_clusters, motion_delta, recent_color

# Gaps in ms, distances of colour and place.
GAP, CROSS_GAP, COLOR_GAP, OPEN_WINDOW, MERGE_WINDOW = 3000, 5000, 1000, 15_000, 30_000
COLOR_SPLIT, COLOR_MERGE, JUMP = 0.25, 0.20, 0.3
CLOSE_IDLE, CLOSE_SEAL, CLOSE_EXIT = 15_000, 3000, 2000


def _distance(a, b) -> float:
    dh = abs(a[0] - b[0])
    dh = min(dh, 1 - dh)
    return ((1.5 * dh) ** 2 + (a[1] - b[1]) ** 2 + (0.5 * (a[2] - b[2])) ** 2) ** 0.5


@dataclass
class OpenEvent:
    """What assignment needs of an event: its start, last rows, and when seals and exits were last seen."""

    event_id: int
    start: int
    recent: list = field(default_factory=list)  # (ts, source, cx, cy, color or None), oldest first
    seal: int | None = None
    exit: int | None = None

    def deadline(self) -> int:
        """When it closes if nothing more comes."""
        at = self.recent[-1][0] + CLOSE_IDLE
        if self.seal is not None:
            at = min(at, self.seal + CLOSE_SEAL)
        return min(at, self.exit + CLOSE_EXIT) if self.exit is not None else at

    def add(self, ts, source, cx, cy, color, class_id, roi) -> None:
        self.recent = [*self.recent[-9:], (ts, source, cx, cy, color)]
        if class_id in (0, 1):
            self.seal = ts
        if roi == "salida":
            self.exit = ts

    def refuses(self, ts, source, cx, cy, color) -> bool:
        """Whether a row is too far from the last ones to belong here."""
        last_ts, last_source, x, y, _ = self.recent[-1]
        gap = ts - last_ts
        limit = CROSS_GAP if source != last_source else GAP
        known = [r[4] for r in self.recent if r[4] is not None]
        differs = color is not None and len(known) >= 2 and _distance(color, [sum(c[k] for c in known) / len(known) for k in range(3)]) > COLOR_SPLIT
        jumped = ((cx - x) ** 2 + (cy - y) ** 2) ** 0.5 > JUMP
        return (gap > limit and (differs or jumped)) or (differs and gap > COLOR_GAP)


class Lane:
    """Open events of a lane, and the event of each next row."""

    def __init__(self, close_rules: bool = True, events: list[OpenEvent] | None = None):
        self.close_rules, self.open = close_rules, events or []

    def close_until(self, ts: int) -> list[tuple[int, int, int]]:
        """(event, start, close time) of events whose deadline is before ``ts``."""
        gone = [(e.event_id, e.start, e.deadline()) for e in self.open if e.deadline() < ts]
        self.open = [e for e in self.open if e.deadline() >= ts]
        return gone

    def assign(self, det_id, ts, source, cx, cy, color, class_id, roi) -> int:
        if self.close_rules:
            self.close_until(ts)
        near = [e for e in self.open if e.start >= ts - OPEN_WINDOW]
        self.open = near if not self.close_rules else self.open
        event = max(near, key=lambda e: (e.start, e.event_id)) if near else None
        if event is None or event.refuses(ts, source, cx, cy, color):
            event = OpenEvent(det_id, ts)
            self.open.append(event)
        event.add(ts, source, cx, cy, color, class_id, roi)
        return event.event_id


_FOLD = ("det_id", "ts_ms", "source_id", "cx", "cy", "color_h", "color_s", "color_v", "class_id", "roi_name")


def _narrow(det: DataFrame, lane: str) -> DataFrame:
    roi = F.col("roi_name") if "roi_name" in det.columns else F.lit("")
    return det.select(F.col(lane).cast("long").alias("lane"), "det_id", "ts_ms", "source_id", (F.col("bbox_left") + F.col("bbox_width") / 2).alias("cx"), (F.col("bbox_top") + F.col("bbox_height") / 2).alias("cy"), "color_h", "color_s", "color_v", "class_id", roi.alias("roi_name"))


def dump_lane(lane: Lane, at: int | None) -> str:
    """The open events of a lane as text; with a time only those that a row from then on can join."""
    open_ = [e for e in lane.open if at is None or e.start >= at - OPEN_WINDOW and not (lane.close_rules and e.deadline() < at)]
    return json.dumps([lane.close_rules, sorted([e.start, e.event_id, e.recent, e.seal, e.exit] for e in open_)])


def load_lane(text: str) -> Lane:
    rules, open_ = json.loads(text)
    return Lane(rules, [OpenEvent(i, start, [(*r[:4], r[4] and tuple(r[4])) for r in recent], seal, exit_) for start, i, recent, seal, exit_ in open_])


def assign_events(det: DataFrame, lane: str = "site_id", close_rules: bool = True, **speculation) -> DataFrame:
    """(det_id, event_id) by the exact fold; an event is named after its first detection.

    After 15 s an event can take no other row, so the fold forgets: it is made in chunks of time at once, see :mod:`.speculation` (whose
    sizes ``speculation`` can set)."""

    def step(state: Lane, i, ts, source, cx, cy, h, s, v, cls, roi):
        return [(i, state.assign(i, ts, source, cx, cy, None if h is None else (h, s, v), cls, roi))]

    return speculative_fold(_narrow(det, lane), "lane", "ts_ms", ("ts_ms", "det_id"), _FOLD, "det_id long, event_id long", lambda: Lane(close_rules), step, dump_lane, load_lane, **speculation)


def assign_events_fast(det: DataFrame, lane: str = "site_id") -> DataFrame:
    """(det_id, event_id): a new event where the gap, colour or jump rule holds against the rows before, or
    after 15 s without any. Windows over blocks of a lane's rows, each with the ten rows before it."""
    need = [lane, *dict.fromkeys(("det_id", "ts_ms", "source_id", "bbox_left", "bbox_top", "bbox_width", "bbox_height", "color_h", "color_s", "color_v"))]
    blocks = with_rows_before(number(det.select(*need), (lane,), "ts_ms", ("ts_ms", "det_id")), (lane,), 10)
    at = (lane, "_block")
    w = W.partitionBy(*at).orderBy("ts_ms", "det_id")
    d = motion_delta(recent_color(blocks, at), at).withColumn("_before", F.lag("source_id").over(w)).where("not _copy")
    limit = F.when(F.col("_before") != F.col("source_id"), CROSS_GAP).otherwise(GAP)
    differs = F.coalesce(hsv_distance(tuple(F.col(f"color_{c}") for c in "hsv"), tuple(F.col(f"recent_{c}") for c in "hsv")) > COLOR_SPLIT, F.lit(False))
    late, gap = F.col("gap_ms") > limit, F.col("gap_ms")
    new = gap.isNull() | (late & (differs | (F.col("jump") > JUMP))) | (differs & (gap > COLOR_GAP)) | (gap > OPEN_WINDOW)
    d = d.select(lane, "_block", "_at", "det_id", F.when(new, F.struct("_at", "det_id")).alias("_first"))
    # an event that goes on from an earlier block
    begun = d.groupBy(lane, "_block").agg(F.max("_first").alias("_old"))
    begun = begun.select(F.col(lane).alias("_lane"), F.col("_block").alias("_of"), F.max("_old").over(W.partitionBy(lane).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_old"))
    d = d.join(begun, F.col(lane).eqNullSafe(F.col("_lane")) & (F.col("_block") == F.col("_of")), "left")
    first = F.coalesce(F.max("_first").over(W.partitionBy(*at).orderBy("_at")), F.col("_old"))
    return d.select("det_id", first["det_id"].alias("event_id"))


def close_times(det: DataFrame, tick_ms: int | None = None) -> DataFrame:
    """(event, close_ms): the first moment at which an event's rows leave 15 s of silence, 3 s after seals, or 2 s
    after an exit; rounded up to the tick if there is one."""
    w = W.partitionBy("event_id").orderBy("ts_ms", "det_id")
    ahead = w.rowsBetween(1, W.unboundedFollowing)
    rules = []
    for wait, cond in ((CLOSE_IDLE, F.lit(True)), (CLOSE_SEAL, F.col("class_id").isin(0, 1)), (CLOSE_EXIT, F.col("roi_name") == "salida")):
        nxt = F.min(F.when(cond, F.col("ts_ms"))).over(ahead)
        rules.append(F.when(cond & (nxt.isNull() | (nxt - F.col("ts_ms") > wait)), F.col("ts_ms") + wait))
    d = det.withColumn("_at", F.least(*rules))
    at = d.groupBy("event_id").agg(F.min("_at").alias("close_ms"))
    return at.withColumn("close_ms", (F.ceil(F.col("close_ms") / tick_ms) * tick_ms).cast("long")) if tick_ms else at


def close_on_cross(events: DataFrame, crossings: DataFrame, lane: str = "site_id") -> DataFrame:
    """(event, end): the newest event begun at most 15 s before a crossing ends with it, the first that hits."""
    hits = open_event_at(crossings, events, OPEN_WINDOW, lane).where("open_event_id is not null")
    return hits.groupBy(F.col("open_event_id").alias("event_id")).agg(F.min("ts_ms").alias("end_ms"))


def split_events(det: DataFrame) -> DataFrame:
    """(det_id, event_id, new_event_id): in events with clusters of clearly different colours, the second cluster and
    those after it become events of their own, named by the negative of their first detection; rows outside clusters stay."""
    c = gap_clusters(det)
    order = W.partitionBy("event_id").orderBy("cluster")
    far = distinct_clusters(avg_color(c, ("event_id", "cluster"))).where("splittable")
    moved = c.join(far.select("event_id"), "event_id", "left_semi").withColumn("_n", F.dense_rank().over(order)).where("_n > 1")
    moved = moved.select("det_id", (-1 - F.min("det_id").over(W.partitionBy("event_id", "cluster"))).alias("_new"))
    return det.join(moved, "det_id", "left").select("det_id", "event_id", F.coalesce("_new", "event_id").alias("new_event_id"))


def merge_events(events: DataFrame, lane: str = "site_id") -> DataFrame:
    """(event_id, merged_into) for closed events with the sums of their colours.

    ``events`` has lane, event_id, start_ms, end_ms, n_colored and color_h, _s, _v (means). Each event, in order of
    its start, joins the one that ended last before it if the gap and the colours are close; that one's end and mean
    colour then grow, which the next decision sees, so it is a fold. Where all events of a lane ended more than 30 s
    before, nothing can be joined any more; lanes are cut there and their pieces are folded apart."""

    def step(kept: list, _key, i, start, end, n, h, s, v):
        # an event that ended too long ago can take no more, and neither can those of later starts see it
        kept[:] = [e for e in kept if start - e["end"] <= MERGE_WINDOW]
        sums = [n * c for c in (h, s, v)] if n >= 1 else [0.0] * 3
        prev = max((e for e in kept if e["end"] < start), key=lambda e: (e["end"], e["id"]), default=None)
        if prev and n >= 2 and prev["n"] >= 2 and _distance([c / n for c in sums], [c / prev["n"] for c in prev["sums"]]) <= COLOR_MERGE:
            prev["end"], prev["n"], prev["sums"] = max(prev["end"], end), prev["n"] + n, [a + b for a, b in zip(prev["sums"], sums, strict=True)]
            return [(i, prev["id"])]
        kept.append({"id": i, "end": end, "n": n, "sums": sums})
        return [(i, i)]

    e = events.select(F.col(lane).cast("long").alias("lane"), "event_id", "start_ms", "end_ms", F.col("n_colored").cast("long").alias("n_colored"), *(F.coalesce(F.col(f"color_{c}"), F.lit(0.0)).alias(f"color_{c}") for c in "hsv"))
    columns = ("event_id", "start_ms", "end_ms", "n_colored", "color_h", "color_s", "color_v")
    return fold_rows(cut(e, ("lane",), "start_ms", MERGE_WINDOW, end="end_ms"), ("lane", "_piece"), ("start_ms", "event_id"), columns, "event_id long, merged_into long", list, step)


def colors_of(det: DataFrame, lane: str = "site_id") -> DataFrame:
    """Events of detections with their lane, ends, and colour means of whatever rows are coloured."""
    return det.groupBy("event_id").agg(F.min(lane).alias(lane), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("color_h").alias("n_colored"), *(F.avg(f"color_{c}").alias(f"color_{c}") for c in "hsv"))


def finalize(det: DataFrame, lane: str = "site_id") -> DataFrame:
    """Split, merge, vote and read the code: one row a final event. A merged event's verdict is that of the
    event it went into, before the merge."""
    s = split_events(det).select("det_id", "new_event_id")
    d = det.join(s, "det_id").withColumn("event_id", F.col("new_event_id")).drop("new_event_id")
    merged = merge_events(colors_of(d, lane), lane)
    votes = seal_vote(d)
    d = d.join(merged, "event_id").withColumn("event_id", F.col("merged_into")).drop("merged_into")
    span = d.groupBy("event_id").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"))
    codes = code_consensus(d.withColumn("full_text", F.lit("")) if "full_text" not in d.columns else d)
    return span.join(votes.select("event_id", "seal_status", "seal_confidence"), "event_id").join(codes.select("event_id", "container_code"), "event_id", "left")


def open_from_frames(frames: DataFrame, lane: str = "source_id", within_ms: int = 3000) -> DataFrame:
    """Times at which a frame with an object opens an event, none having opened within 3 s: a chain over the lane's
    times (see :mod:`.chains`)."""
    f = frames.select(F.col(lane).cast("long").alias("lane"), "ts_ms").distinct()
    return let_through(f, ("lane",), "ts_ms", ("ts_ms",), within_ms, strict=True).select("lane", F.col("ts_ms").alias("start_ms"))


def seal_verdict_per_pass(det: DataFrame, lane: str = "site_id") -> DataFrame:
    """Verdict of each pass: clusters of a lane's detections by time, at least three rows, then the vote."""
    return seal_vote(lane_clusters(det, lane, several=False), (lane, "cluster"))
