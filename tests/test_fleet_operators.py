"""Flags, pairing, pages, health and sessions against brute force."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from gateflow.operators import aggregates as agg
from gateflow.operators import filters as flt
from gateflow.operators import joins as jn
from gateflow.operators import topk
from gateflow.operators import windows as win
from gateflow.streaming import operators as live
from gateflow.streaming.run import run_available, run_complete


def test_frame_flags(spark):
    rows = [(1, 1, "a", False), (1, 1, "a", True), (1, 1, "b", False), (1, 2, "", False), (1, 2, "", False), (1, 2, "", False), (2, 1, "salida", False)]
    df = spark.createDataFrame(rows, "source_id int, frame_num long, roi_name string, crossed boolean")
    got = {(r.source_id, r.frame_num): (r.any_roi, r.any_exit, r.any_crossing, r.crowded) for r in agg.frame_flags(df, 1).collect()}
    assert got == {(1, 1): (True, False, True, True), (1, 2): (False, False, False, False), (2, 1): (True, True, False, False)}
    assert not any(r.crowded for r in agg.frame_flags(df).collect())


def scored(a, b):
    def overlap(low, size):
        return max(0.0, min(a[low] + a[size], b[low] + b[size]) - max(a[low], b[low]))

    x, y, shared = a[2] * a[3], b[2] * b[3], overlap(0, 2) * overlap(1, 3)
    return round(0.6 * shared / (x + y - shared) + 0.4 * min(x, y) / max(x, y), 9)


def test_boxes_are_paired_greedily(spark):
    """Crowded frames: all that can be paired is, as by going through the pairs in order of their score."""
    rng = random.Random(17)
    rows = [(f * 100 + k, 1, c, f, *(rng.choice([0.1, 0.2, 0.3]) for _ in range(4))) for f in range(6) for c in (0, 1) for k in range(c * 50, c * 50 + rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "det_id long, source_id int, class_id int, frame_num long, bbox_left double, bbox_top double, bbox_width double, bbox_height double")
    want = set()
    for f in range(6):
        for c in (0, 1):
            new, old = ([r for r in rows if r[3] == at and r[2] == c] for at in (f + 1, f))
            used: set = set()
            for s, i, j in sorted(((-scored(a[4:], b[4:]), a[0], b[0]) for a in new for b in old)):
                if ("n", i) not in used and ("o", j) not in used:
                    used |= {("n", i), ("o", j)}
                    want.add((i, j, -s))
    got = {(r.det_id, r.prev_det, r.score) for r in jn.pair_score(df).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want} and sorted(g[2] for g in got) == pytest.approx(sorted(w[2] for w in want))
    assert jn.pair_score(df.limit(0)).count() == 0


def test_pages(spark):
    df = spark.range(60).selectExpr("id AS event_id", "id % 7 AS start_ms")
    order = [i for _, i in sorted(((-(i % 7), -i) for i in range(60)))]
    for k, want in ((1, order[:25]), (2, order[25:50]), (3, order[50:]), (9, order[50:]), (0, order[:25]), (-1, order[:25])):
        rows = topk.page(df, k).collect()
        assert sorted(-r.event_id for r in rows) == sorted(want) and {r.total for r in rows} == {60}
    assert topk.page(df.limit(0), 3).count() == 0 and topk.page(df.where("event_id < 50"), 2).count() == 25 and topk.page(df.where("event_id < 50"), 5).count() == 25


def test_thresholds_do_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (2, 0.5)], "class_id int, confidence double")
    t = spark.createDataFrame([(1, 0.4), (1, 0.45), (99, 0.0)], "class_id int, threshold double")
    assert sorted(map(tuple, flt.filter_confidence(df, t).collect())) == [(1, 0.5), (2, 0.7)]


@pytest.mark.parametrize("span", [3, 10_000])
def test_health_and_watchdog_over_spans(spark, span):
    rng = random.Random(span)
    pings = [(d, c, rng.random() < 0.4) for d in (1, 2, None) for c in sorted(rng.sample(range(400), 150))]
    got = {(r.device_id, r.cycle): (r.failure_count, r.is_online, r.changed, r.offline_since) for r in win.device_health(spark.createDataFrame(pings, "device_id int, cycle long, ok boolean"), span=span).collect()}
    want = {}
    for d in (1, 2, None):
        n, since, was = 0, None, None
        for _, c, ok in sorted((p for p in pings if p[0] == d), key=lambda p: p[1]):
            n = 0 if ok else n + 1
            since = None if n < 3 else c if n == 3 else since
            want[d, c] = (n, n < 3, was is not None and was != (n < 3), since)
            was = n < 3
    assert got == want
    fps = [(d, c, rng.choice([0, 0, 0, 3, 3, 20 if rng.random() < 0.1 else 0])) for d in (1, 2) for c in range(300)]
    got = {(r.device_id, r.cycle, r.reason) for r in win.watchdog_runs(spark.createDataFrame(fps, "device_id int, cycle long, fps int"), zero_cycles=4, low_cycles=3, span=span).collect()}
    want = set()
    for d in (1, 2):
        zero = low = 0
        for _, c, v in (p for p in fps if p[0] == d):
            zero, low = (0, 0) if v >= 6 else (zero + (v == 0), low + (v > 0))
            if v < 6 and (v == 0 and zero % 4 == 0 or v > 0 and low % 3 == 0):
                want.add((d, c, "zero" if v == 0 else "low"))
    assert got == want


def test_a_device_with_most_rows_is_spread(spark):
    df = spark.range(200_000).selectExpr("1 AS device_id", "id AS cycle", "id % 50000 = 0 AS ok")
    out = win.device_health(df)
    assert out.where("changed").count() == 7 and out.agg(F.max("failure_count")).first()[0] == 49_999
    assert {r.offline_since for r in out.where("offline_since is not null").select("offline_since").distinct().collect()} == {3, 50_003, 100_003, 150_003}


def test_live_sessions(spark, tmp_path):
    """Late rows extend a session, or join two; what is told in the end is the batch's."""
    batches = [[(1, 1000), (1, 20_000), (2, 5000)], [(1, 90_000), (1, 55_000)], [(1, 78_000), (2, 400_000)], [(1, 900_000), (2, 900_000)]]
    for k, part in enumerate(batches):
        seen = set(glob.glob(f"{tmp_path}/*.parquet"))
        spark.createDataFrame(part, "user_id long, ts_ms long").withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path))
        for f in set(glob.glob(f"{tmp_path}/*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    table = spark.read.parquet(str(tmp_path))
    stream = lambda: live.stream_sessions(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)), delay="60 seconds")
    want = {tuple(r) for r in win.session_starts(table).collect()}
    assert want == {(1, 1000, 20_000, 2), (1, 55_000, 90_000, 3), (1, 900_000, 900_000, 1), (2, 5000, 5000, 1), (2, 400_000, 400_000, 1), (2, 900_000, 900_000, 1)}
    assert {tuple(r) for r in run_complete(stream()).collect()} == want
    assert {tuple(r) for r in run_available(stream()).collect()} == {w for w in want if w[1] < 800_000}
