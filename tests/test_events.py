"""Event construction on hand-made sequences, folds against plain restatements, and properties."""

import math

import pytest
from pyspark.sql import functions as F

from gateflow.operators import aggregates as agg
from gateflow.operators import events as ev
from gateflow.operators import windows as win

COLS = "det_id long, site_id int, event_id long, ts_ms long, source_id int, class_id int, bbox_left double, bbox_top double, bbox_width double, bbox_height double, color_h double, color_s double, color_v double, roi_name string"


def dets(spark, rows):
    """Rows of (ts_ms, options)."""
    out = []
    for i, (ts, o) in enumerate(rows):
        h, s, v = o.get("color") or (None, None, None)
        out.append((i, o.get("site", 1), o.get("event", 1), ts, o.get("source", 0), o.get("cls", 4), o.get("x", 0.1), 0.1, 0.1, 0.1, h, s, v, o.get("roi", "")))
    return spark.createDataFrame(out, COLS)


def events_of(df):
    return [r.event_id for r in df.orderBy("det_id").collect()]


def distance(a, b):
    dh = abs(a[0] - b[0])
    dh = min(dh, 1 - dh)
    return math.sqrt((1.5 * dh) ** 2 + (a[1] - b[1]) ** 2 + (0.5 * (a[2] - b[2])) ** 2)


def plain(rows, close_rules):
    """The rules of assignment, written out again over (ts, options): index of each row's event's first row."""
    events, out = [], []
    for i, (ts, o) in enumerate(rows):
        source, x, color = o.get("source", 0), o.get("x", 0.1) + 0.05, o.get("color")

        def closed(e, ts=ts):
            last = e["rows"][-1][0]
            limits = [last + 15000]
            seals = [r[0] for r in e["rows"] if r[4] in (0, 1)]
            exits = [r[0] for r in e["rows"] if r[5] == "salida"]
            limits += [seals[-1] + 3000] if seals else []
            limits += [exits[-1] + 2000] if exits else []
            return min(limits) < ts

        if close_rules:
            for e in events:
                e["over"] = e["over"] or closed(e)
        near = [e for e in events if not e["over"] and e["start"] >= ts - 15000]
        pick = max(near, key=lambda e: (e["start"], e["id"])) if near else None
        if pick:
            last = pick["rows"][-1]
            gap, limit = ts - last[0], 5000 if last[1] != source else 3000
            known = [r[3] for r in pick["rows"][-10:] if r[3]]
            mean = [sum(c[k] for c in known) / len(known) for k in range(3)] if len(known) >= 2 else None
            far = bool(color and mean and distance(color, mean) > 0.25)
            if (gap > limit and (far or abs(x - last[2]) > 0.3)) or (far and gap > 1000):
                pick = None
        if pick is None:
            pick = {"id": i, "start": ts, "rows": [], "over": False}
            events.append(pick)
        pick["rows"].append((ts, source, x, color, o.get("cls", 4), o.get("roi", "")))
        out.append(pick["id"])
    return out


RED, BLUE = (0.0, 0.8, 0.5), (0.6, 0.8, 0.5)
CASES = {
    "gap edge": [(0, {}), (3000, {"x": 0.5}), (6001, {"x": 0.9})],
    "cross source": [(0, {}), (5000, {"source": 1, "x": 0.5}), (10001, {"source": 0, "x": 0.1})],
    "colour": [(0, {"color": RED}), (100, {"color": RED}), (1000, {"color": BLUE}), (2600, {"color": BLUE})],
    "cap": [(t, {}) for t in range(0, 40_000, 1000)],
    "seal closes": [(0, {}), (1000, {"cls": 0}), (4000, {}), (4001, {}), (5000, {})],
    "exit closes": [(0, {}), (1000, {"roi": "salida"}), (3000, {}), (3001, {}), (3500, {})],
    "two open": [(0, {"color": RED}), (10, {"color": RED}), (1500, {"color": BLUE}), (1600, {"color": BLUE}), (1700, {"color": RED}), (3000, {"color": RED})],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("close_rules", [True, False])
def test_assignment_is_the_rules(spark, name, close_rules):
    df = dets(spark, CASES[name])
    assert events_of(ev.assign_events(df, close_rules=close_rules)) == plain(CASES[name], close_rules)


def test_assignment_does_not_depend_on_partitions(spark):
    rows = [(t * 700 % 60_000, {"color": RED if t % 7 < 4 else BLUE, "source": t % 2, "site": 1 + t % 3}) for t in range(200)]
    df = dets(spark, rows)
    assert events_of(ev.assign_events(df.repartition(7))) == events_of(ev.assign_events(df.coalesce(1)))


def test_fast_is_exact_for_short_segments(spark):
    rows = [(k * 30_000 + j * 900, {"color": RED if j < 5 else BLUE, "x": 0.1 + (j % 3) * 0.2}) for k in range(8) for j in range(10)]
    df = dets(spark, rows)
    assert events_of(ev.assign_events_fast(df)) == events_of(ev.assign_events(df, close_rules=False))


def test_clusters(spark):
    rows = [(0, {}), (3000, {}), (6000, {}), (9001, {}), (9002, {}), (20_000, {}), (25_000, {"source": 1}), (25_001, {"source": 1})]
    got = {r.det_id: r.cluster for r in win.gap_clusters(dets(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 5: 2, 6: 2, 7: 2}


@pytest.mark.parametrize(("classes", "status", "share"), [((0, 0, 0, 1), "con_sello", 0.75), ((0, 1), "indeterminado", 0.5), ((4,), "indeterminado", 0.0), ((1,), "sin_sello", 1.0)])
def test_vote(spark, classes, status, share):
    r = agg.seal_vote(dets(spark, [(k, {"cls": c}) for k, c in enumerate(classes)])).first()
    assert (r.seal_status, r.seal_confidence) == (status, share)


def test_close_times(spark):
    rows = [(0, {"event": 1}), (15_001, {"event": 1}), (0, {"event": 2, "cls": 0}), (1, {"event": 2}), (0, {"event": 3, "roi": "salida"}), (0, {"event": 4})]
    got = {r.event_id: r.close_ms for r in ev.close_times(dets(spark, rows)).collect()}
    assert got == {1: 15_000, 2: 3000, 3: 2000, 4: 15_000}
    assert {r.event_id: r.close_ms for r in ev.close_times(dets(spark, rows), 5000).collect()}[2] == 5000


def merge(spark, rows):
    df = spark.createDataFrame(rows, "site_id int, event_id long, start_ms long, end_ms long, n_colored long, color_h double, color_s double, color_v double")
    return {r.event_id: r.merged_into for r in ev.merge_events(df).collect()}


def test_merges(spark):
    one = (1, 1, 0, 1000, 2, *RED)
    assert merge(spark, [one, (1, 2, 31_000, 32_000, 2, *RED)]) == {1: 1, 2: 1}
    assert merge(spark, [one, (1, 2, 31_001, 32_000, 2, *RED)]) == {1: 1, 2: 2}
    assert merge(spark, [one, (1, 2, 2000, 3000, 1, *RED)]) == {1: 1, 2: 2}
    assert merge(spark, [one, (1, 2, 2000, 3000, 2, *BLUE)]) == {1: 1, 2: 2}
    chain = [one, (1, 2, 20_000, 21_000, 2, *RED), (1, 3, 50_000, 51_000, 2, *RED)]
    assert merge(spark, chain) == {1: 1, 2: 1, 3: 1}


def test_split_loses_no_row(spark):
    rows = [(k * 100, {"color": RED}) for k in range(4)] + [(10_000 + k * 100, {"color": BLUE}) for k in range(4)] + [(30_000, {}), (30_001, {})]
    s = ev.split_events(dets(spark, rows)).orderBy("det_id").collect()
    assert len(s) == 10
    assert [r.new_event_id == 1 for r in s] == [True] * 4 + [False] * 4 + [True] * 2


def test_watchdog_counters():
    c = win.WatchdogCounter()
    assert [c.see(t * 10, 0) for t in range(12)][-2:] == [None, "zero"]
    c = win.WatchdogCounter()
    for t in range(11):
        c.see(t * 10, 0)
    assert c.see(110, 3) is None  # a low cycle leaves the zeros
    assert c.see(120, 0) == "zero"
    c = win.WatchdogCounter()
    assert not any(c.see(t * 20, 0) for t in range(11))  # 180 s after its first hit a counter is gone
    assert c.see(300, 30) is None and c.zero == (0, 0)


def test_throttle_keeps_its_distance(spark):
    rows = [(t * 37, {"source": t % 2}) for t in range(300)]
    got = win.throttle(dets(spark, rows), ("source_id",), 1000).groupBy("source_id").agg(F.sort_array(F.collect_list("ts_ms")).alias("t")).collect()
    for r in got:
        assert all(b - a >= 1000 for a, b in zip(r.t, r.t[1:]))


def test_code_consensus(spark):
    cols = "event_id long, det_id long, ts_ms long, class_id int, ocr_processed boolean, ocr_text string, ocr_confidence double, full_text string"
    a, b, bad = "CSQU3054383", "MSCU6639870", "CSQU3054384"
    rows = [
        (1, 1, 1, 3, True, a, 0.9, ""), (1, 2, 2, 3, True, b, 0.9, ""),  # a tie: the newest wins
        (2, 3, 1, 3, True, a, 0.9, ""),  # one row is not enough
        (3, 4, 1, 3, True, bad, 0.9, ""), (3, 5, 2, 3, True, "", 0.9, ""),
        (4, 6, 1, 3, True, a, 0.5, f"x{b}"), (4, 7, 2, 3, True, a.lower(), 0.6, ""), (4, 8, 3, 3, False, b, 0.9, b),
    ]
    got = {r.event_id: r.container_code for r in agg.code_consensus(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: b, 4: a}
