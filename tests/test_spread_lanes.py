"""Folds over one lane that never pauses, spread over tasks: the same rows as the serial fold."""

import random

import pytest

from gateflow.operators import events as ev
from gateflow.operators import windows as win
from gateflow.operators.chains import _ways_out, let_through
from gateflow.operators.events import Lane, dump_lane, load_lane
from gateflow.operators.speculation import speculative_fold


def serial(rows, interval, strict):
    """Ids that a limiter lets through, of (key, ts, id)."""
    last, out = {}, set()
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or (ts - last[key] > interval if strict else ts - last[key] >= interval):
            last[key] = ts
            out.add(i)
    return out


def lanes(seed, n, step):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.randrange(step)
        rows.append((rng.choice([1, 1, 1, 2, None]), at, i))
    return rows


@pytest.mark.parametrize(("strict", "chunk"), [(False, 3), (True, 64)])
def test_chains(spark, strict, chunk):
    rows = lanes(chunk, 600, 9)
    df = spark.createDataFrame(rows, "lane int, ts_ms long, det_id long").repartition(5)
    for interval in (25, 10**6):
        got = let_through(df, ("lane",), "ts_ms", ("ts_ms", "det_id"), interval, strict, chunk)
        assert {r.det_id for r in got.collect()} == serial(rows, interval, strict)
    assert let_through(df.limit(0), ("lane",), "ts_ms", ("ts_ms",), 5).count() == 0 and let_through(df, ("lane",), "ts_ms", ("ts_ms",), 0).count() == 600


def test_ways_out():
    assert _ways_out([8, 9, 10, 11], [10, 12, 11, None]) == [None, 12, None, None]
    assert _ways_out([0, 1, 2], [2, 2, 5]) == [5, 5, 5]


def test_one_lane_without_a_pause_is_dealt_out(spark):
    """A row every 10 ms for an hour and more, on one lane: dealt by lane and chunk, and never all in one task."""
    df = spark.range(400_000).selectExpr("1 AS source_id", "id * 10 AS ts_ms", "id AS det_id")
    out = win.throttle(df, ("source_id",), 1000)
    assert out.count() == 4000 and out.where("ts_ms % 1000 <> 0").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__k0#" in plan and "__chunk#" in plan.split("hashpartitioning(__k0#", 1)[1].split(")")[0]


def detections(seed, n=900):
    """One lane, a row every 0.2 s on average and never 15 s without: events follow each other for ever."""
    rng = random.Random(seed)
    rows, at, hue = [], 1000, 0.1
    for i in range(n):
        at += rng.choice([0, 100, 200, 300, 500, 3500] if rng.random() < 0.1 else [50, 100, 200])
        hue = rng.random() if rng.random() < 0.02 else hue
        color = (None, None, None) if rng.random() < 0.1 else (hue, 0.5, 0.5)
        rows.append((1, i, at, rng.randrange(2), rng.random() * 0.1, 0.2, 0.1, 0.1, *color, rng.choice([0, 2, 3]), rng.choice(["", "", "", "salida"] if rng.random() < 0.05 else [""])))
    return rows


SCHEMA = "site_id int, det_id long, ts_ms long, source_id int, bbox_left double, bbox_top double, bbox_width double, bbox_height double, color_h double, color_s double, color_v double, class_id int, roi_name string"


def serial_events(rows, close_rules):
    lane, out = Lane(close_rules), {}
    for _, i, ts, source, left, top, w, h, ch, cs, cv, cls, roi in sorted(rows, key=lambda r: (r[2], r[1])):
        out[i] = lane.assign(i, ts, source, left + w / 2, top + h / 2, None if ch is None else (ch, cs, cv), cls, roi)
    return out


@pytest.mark.parametrize(("close_rules", "warm", "rounds"), [(True, 60_000, 3), (True, 500, 1), (False, 500, 3)])
def test_speculation(spark, close_rules, warm, rounds):
    """With a warm-up that is too short chunks are wrong and are run again, in rounds or in one run to the end; the rows are the same."""
    rows = detections(warm + rounds)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    wrong: list[int] = []
    got = ev.assign_events(df, close_rules=close_rules, chunk_ms=10_000, warm_ms=warm, rounds=rounds, told=wrong.append)
    assert {r.det_id: r.event_id for r in got.collect()} == serial_events(rows, close_rules) and got.count() == len(rows)
    if warm == 500:
        assert wrong[0] > 0


def test_repairs_reach_far(spark):
    """A fold that forgets nothing (a running count) is wrong in every chunk but the first, and right after the last resort."""
    df = spark.createDataFrame([(k, 10 * i + k, 1) for i in range(200) for k in (1, 2, None) if k], "k int, ts long, n int").unionAll(spark.createDataFrame([(None, 7 * i, 1) for i in range(50)], "k int, ts long, n int"))
    wrong: list[int] = []

    def step(state, ts, n):
        state[0] += n
        return [(ts, state[0])]

    out = speculative_fold(df, "k", "ts", ("ts",), ("ts", "n"), "at long, total long", lambda: [0], step, lambda s, at: str(s[0]), lambda t: [int(t)], 100, 0, 2, wrong.append)
    got = sorted((r.at, r.total) for r in out.collect())
    assert got == sorted([(10 * i + k, i + 1) for i in range(200) for k in (1, 2)] + [(7 * i, i + 1) for i in range(50)]) and len(wrong) == 2 and wrong[0] > 20
    assert speculative_fold(df.limit(0), "k", "ts", ("ts",), ("ts", "n"), "at long, total long", lambda: [0], step, lambda s, at: str(s[0]), lambda t: [int(t)]).count() == 0


def test_lane_state_goes_through_text():
    lane = Lane(True)
    for row in detections(3, 60):
        lane.assign(row[1], row[2], row[3], row[4], row[5], row[8] and row[8:11], row[11], row[12])
    text = dump_lane(lane, None)
    assert dump_lane(load_lane(text), None) == text and load_lane(text).open[0].deadline() == sorted(lane.open, key=lambda e: (e.start, e.event_id))[0].deadline()
    assert dump_lane(lane, 10**9) == dump_lane(Lane(True), 0)
