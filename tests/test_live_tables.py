"""Tables that change while a stream runs, the upserted table, and as-of joins: batch by batch, and against brute force."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from gateflow.operators import joins as jn
from gateflow.operators.asof import first_after, last_before
from gateflow.streaming import dimensions as dim
from gateflow.streaming import operators as live
from gateflow.streaming.run import run_available
from gateflow.streaming.upserts import GONE, KeyedTable


def files(spark, path, schema, *batches):
    """A stream of one file a batch, in this order."""
    for k, rows in enumerate(batches):
        seen = set(glob.glob(f"{path}/*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in set(glob.glob(f"{path}/*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_changed_map_reaches_the_rows_after_it(spark, tmp_path):
    """Three micro-batches: mapped anew in the second, taken out in the third."""
    det = files(spark, f"{tmp_path}/d", "det_id long, source_id int, ts_ms long, note string", [(1, 0, 100, "a"), (2, 1, 100, None)], [(3, 0, 2100, "b"), (4, 0, 1900, "c")], [(5, 0, 3100, "d"), (6, None, 3100, "e")])
    changes = files(spark, f"{tmp_path}/c", "source_id int, device_id int, ts_ms long", [(0, 7, 50)], [(0, 8, 2000), (1, 9, 2000)], [(0, None, 3000)])
    got = {r.det_id: (r.device_id, r.note) for r in run_available(live.stream_map(det, changes, forget_ms=None)).collect()}
    assert got == {1: (7, "a"), 2: (-1, None), 3: (8, "b"), 4: (7, "c"), 5: (-1, "d"), 6: (-1, "e")}


def test_an_expired_preset_stops_filtering(spark, tmp_path):
    schema = "event_id long, device_id int, ts_ms long, roi array<string>, lc array<string>, oc array<string>, direction string, analytics map<string,string>"
    event = lambda i, ts, direction="p1_in": (i, 1, ts, ["p1_a", "p2_a"], [], None, direction, {"p1_a": "1", "p2_a": "2"})
    events = files(spark, f"{tmp_path}/e", schema, [event(1, 500), event(2, 1500, "in")], [event(3, 121_000), event(4, 120_999)], [event(5, 200_000), event(6, 201_000)])
    changes = files(spark, f"{tmp_path}/c", "device_id int, active_token string, ts_ms long", [(1, "p1", 1000)], [(2, "p1", 0)], [(1, "p2", 200_000), (1, "__fixed__", 201_000)])
    out = run_available(live.stream_preset_filter(events, changes, forget_ms=None)).collect()
    got = {r.event_id: (r.roi, r.direction, sorted(r.analytics)) for r in out}
    every, own = ["p1_a", "p2_a"], ["p1_a"]
    assert got == {1: (every, "p1_in", every), 2: (own, "", own), 3: (every, "p1_in", every), 4: (own, "p1_in", own), 5: (["p2_a"], "", ["p2_a"]), 6: (every, "p1_in", every)}


def test_new_shapes_replace_the_old(spark, tmp_path):
    shape = "device_id int, ts_ms long, shapes array<struct<name:string,isClosed:boolean,points:array<struct<x:double,y:double>>>>"
    square = lambda name, x: [(name, True, [(x, 0.0), (x + 0.4, 0.0), (x + 0.4, 1.0), (x, 1.0)])]
    det = files(spark, f"{tmp_path}/d", "det_id long, device_id int, ts_ms long, bbox_left double, bbox_top double, bbox_width double, bbox_height double", [(1, 1, 10, 0.1, 0.5, 0.1, 0.1)], [(2, 1, 30, 0.1, 0.5, 0.1, 0.1), (3, 1, 30, 0.6, 0.5, 0.1, 0.1)], [(4, 1, 50, 0.6, 0.5, 0.1, 0.1)])
    changes = files(spark, f"{tmp_path}/c", shape, [(1, 0, square("left", 0.0))], [(1, 20, square("right", 0.5))], [(1, 40, [])])
    assert {r.det_id: r.roi_name for r in run_available(live.stream_roi(det, changes, forget_ms=None)).collect()} == {1: "left", 2: "", 3: "right", 4: ""}


def test_live_is_the_as_of_join(spark, tmp_path):
    rng = random.Random(4)
    facts = [(i, rng.choice([1, 2, None]), rng.randrange(300_000), rng.random(), [str(i)] if i % 3 else None) for i in range(400)]
    changes = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.randrange(300_000), i) for i in range(40)] + [(1, "x", 5, 100), (1, "y", 5, 101)]
    f, c = files(spark, f"{tmp_path}/f", "id long, k int, ts_ms long, x double, l array<string>", facts), files(spark, f"{tmp_path}/c", "k int, v string, ts_ms long, number long", changes)
    got = run_available(dim.with_live(f, c, ["k"], ["v"], number="number", ttl_ms=20_000, keep_ms=10**9, forget_ms=None)).collect()
    table = lambda p: spark.read.parquet(f"{tmp_path}/{p}")
    want = dim.as_of(table("f"), table("c"), ["k"], ["v"], number="number", ttl_ms=20_000).collect()

    def plain(k, at):
        old = max(((t, n, v) for ck, v, t, n in changes if ck == k and t <= at), default=None)
        return old[2] if old and at - old[0] < 20_000 else None

    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(r.id, r.x, r.v) for r in got} == {(i, x, plain(k, at)) for i, k, at, x, _ in facts}


def test_versions_are_pruned():
    held: list = []
    for at in (10, 30, 20, 30, 100):
        dim.add_version(held, [at, 0, str(at)], 75)
    assert [v[0] for v in held] == [20, 30, 100]
    assert [dim.newest_at(held, at, None) for at in (19, 20, 99, 100)] == [None, "20", "30", "100"] and dim.newest_at(held, 130, 30) is None


def test_the_upserted_table(spark, tmp_path):
    """A key in five batches, one of them run twice, has one row; a key that goes is gone; a base changes nothing."""
    table = KeyedTable(str(tmp_path / "t"), ("k",), "k long, v string")
    assert table.read(spark).count() == 0 and table.compact(spark) is None
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    for n in range(5):
        table.write(rows((1, f"v{n}"), (10 + n, "new")), n)
        if n == 2:
            table.write(rows((1, f"v{n}"), (10 + n, "new")), n)
    read = lambda: {r.k: r.v for r in table.read(spark).collect()}
    want = {1: "v4", **{10 + n: "new" for n in range(5)}}
    assert read() == want and table.read(spark).count() == 6
    table.write(spark.createDataFrame([(1, None, True), (12, "back", False)], f"k long, v string, {GONE} boolean"), 5)
    want = {**want, 12: "back"}
    del want[1]
    assert read() == want
    before = table.read(spark)
    assert table.compact(spark, 3) == 3 and read() == want and table.compact(spark, 3) == 3
    assert {r.k: r.v for r in before.collect()} == want  # a reader of the changes that this base replaced can go on
    table.write(rows((1, "again")), 6)
    assert table.compact(spark) == 6 and read() == {**want, 1: "again"}
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/t/changes/*")) == ["v=4", "v=5", "v=6"]
    table.write(rows((7, "x")), 7)
    assert read() == {**want, 1: "again", 7: "x"}
    assert [f.strip().split()[0] for f in live.CONSENSUS.split(",")] == ["event_id", "container_code", "n"]


def test_consensus_is_upserted(spark, tmp_path):
    """The same event in three batches with the detections of the time; an event that loses its code loses its row."""
    schema = "event_id long, det_id long, ts_ms long, class_id int, ocr_processed boolean, ocr_text string, ocr_confidence double, full_text string"
    det = lambda e, i, text: (e, i, i * 10, 3, True, text, 0.9, "")
    good, other = "CSQU3054383", "MSCU6639870"
    now: list = []
    table = KeyedTable(str(tmp_path / "t"), ("event_id",), live.CONSENSUS)
    run = live.consensus_batch(lambda: spark.createDataFrame(now, schema), table)
    read = lambda: {r.event_id: (r.container_code, r.n) for r in table.read(spark).collect()}
    touch = lambda *e: spark.createDataFrame([(x,) for x in e], "event_id long")
    now = [det(1, 1, good), det(1, 2, good), det(2, 3, other), det(2, 4, other)]
    run(touch(1, 2, 1), 0)
    assert read() == {1: (good, 2), 2: (other, 2)}
    now = [*now, det(1, 5, other), det(1, 6, other), det(1, 7, other)]
    run(touch(1), 1)
    run(touch(1), 1)
    assert read() == {1: (other, 3), 2: (other, 2)} and table.read(spark).count() == 2
    now = now[:3]
    run(touch(2), 2)
    assert read() == {1: (other, 3)}


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_joins(spark, strict):
    """Against brute force, over lanes with null keys, many rows of one time, and spans of every size."""
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(0, 5000, 7)]), i) for i in range(300)] + [(3, 1000, i) for i in range(500)]
    probes = [(i, rng.choice([1, 2, 3, 4, None]), rng.choice([None, rng.randrange(-100, 5200)])) for i in range(400)]
    p, r = spark.createDataFrame(probes, "id long, lane int, at long"), spark.createDataFrame(rows, "lane int, ts long, n long").repartition(5)
    for span in (10, 1000, 10**6):
        got = {x.id: x.b and (x.b.ts, x.b.n) for x in last_before(p, r, ("lane",), "at", ("ts", "n"), "b", strict, span).collect()}
        assert got == {i: at if at is None else max(((t, n) for k, t, n in rows if k == lane and t is not None and (t < at if strict else t <= at)), default=None) for i, lane, at in probes}
        got = {x.id: x.b and (x.b.ts, x.b.n) for x in first_after(p, r.where("ts is not null"), ("lane",), "at", "ts", "b", strict, span).collect()}
        assert got == {i: at if at is None else min(((t, n) for k, t, n in rows if k == lane and t is not None and (t > at if strict else t >= at)), default=None) for i, lane, at in probes}
    assert last_before(p.limit(0), r, ("lane",), "at", ("ts", "n"), "b").count() == 0 and last_before(p, r.limit(0), ("lane",), "at", ("ts", "n"), "b").where("b is not null").count() == 0


def test_dense_lanes_make_no_pairs(spark):
    """10,000 events and rows within one window: nothing in the plan makes more rows than went in."""
    events = spark.range(10_000).selectExpr("id AS event_id", "1 AS site_id", "id % 100 AS start_ms", "id % 100 + 1 AS end_ms")
    q = spark.range(10_000).selectExpr("id AS det_id", "1 AS site_id", "id % 200 AS ts_ms")
    plan = jn.open_event_at(q, events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastHashJoin") + plan.count("SortMergeJoin") and "Generate" not in plan and "NestedLoop" not in plan
    got = {r.det_id: r.open_event_id for r in jn.open_event_at(q, events).collect()}
    assert got == {i: 9900 + min(i % 200, 99) for i in range(10_000)}
    before = {r.event_id: (r.prev_event_id, r.gap_ms) for r in jn.prev_event(events).collect()}
    assert before == {i: (9900 + i % 100 - 2, 1) if i % 100 > 1 else (None, None) for i in range(10_000)}
