"""Streams over all that is there equal their batch twins, in one batch or in many."""

import glob
import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gateflow.operators import events as ev
from gateflow.operators import windows as win
from gateflow.plans.fixtures import Views
from gateflow.streaming import operators as live
from gateflow.streaming.run import read_table, run_available

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=[1, 4])
def files(request, spark, tmp_path_factory):
    """Detections as files in order of time, read one a batch."""
    root = str(tmp_path_factory.mktemp(f"det{request.param}"))
    d = Views(spark, SF)("detections").withColumn("ts_ms", F.col("ts_ms") + 1000).withColumn("ts", F.timestamp_millis("ts_ms"))
    n, seen = d.count(), set()
    at = F.row_number().over(W.orderBy("ts_ms", "det_id")) - 1  # the derived clock runs back and forth with the ids
    numbered = d.withColumn("at", at)
    for k in range(request.param):
        numbered.where((F.col("at") >= n * k // request.param) & (F.col("at") < n * (k + 1) // request.param)).drop("at").coalesce(1).write.mode("append").parquet(root)
        for f in set(glob.glob(f"{root}/*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + 10 * k,) * 2)  # files are read in order of their times
            seen.add(f)
    return spark.read.parquet(root), spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(root)


def test_events(files):
    batch, stream = files
    out = run_available(live.stream_events(stream)).cache()
    got = {r.det_id: r.event_id for r in out.where("kind = 'assign'").collect()}
    late = {r.det_id for r in out.where("kind = 'late'").collect()}
    want = {r.det_id: r.event_id for r in ev.assign_events(batch).collect()}
    assert set(got) | late == set(want)
    if not late:
        assert got == want
    closes = [r.event_id for r in out.where("kind = 'close'").collect()]
    assert len(closes) == len(set(closes)) and set(closes) <= set(want.values())


def test_late_rows_are_told(spark, tmp_path):
    d = Views(spark, SF)("detections").where("site_id = 1").withColumn("ts_ms", F.col("ts_ms") + 1000).withColumn("ts", F.timestamp_millis("ts_ms"))
    root = str(tmp_path / "d")
    d.where("det_id between 20 and 40").coalesce(1).write.parquet(root)
    for f in glob.glob(f"{root}/*.parquet"):
        os.utime(f, (1_700_000_000,) * 2)
    d.where("det_id between 10 and 19").coalesce(1).write.mode("append").parquet(root)
    out = run_available(live.stream_events(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(root), delay="1 hour"))
    kinds = {r.kind: r["count"] for r in out.where("det_id is not null").groupBy("kind").count().collect()}
    n = d.where("det_id between 10 and 19").count()
    assert kinds["late"] == n


def test_throttle(files):
    batch, stream = files
    got = {r.det_id for r in run_available(live.stream_throttle(stream, ["source_id"], 1000)).collect()}
    assert got == {r.det_id for r in win.throttle(batch, ("source_id",), 1000).collect()}


def test_throttle_forgets(spark, tmp_path):
    """A key's state is gone once the watermark is past its interval; what comes then goes through as it would have."""
    rows = [[(1, 1, 1000), (2, 2, 1500)], [(3, 1, 60_000), (4, 1, 60_500)], [(5, 2, 90_000), (6, 1, 90_500)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "det_id long, source_id long, ts_ms long").withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path))
        for f in sorted(glob.glob(f"{tmp_path}/*.parquet"), key=os.path.getmtime)[k:]:
            os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    s = spark.readStream.schema("det_id long, source_id long, ts_ms long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert sorted(r.det_id for r in run_available(live.stream_throttle(s, ["source_id"], 1000)).collect()) == [1, 2, 3, 5, 6]


def test_watchdog(spark):
    f = Views(spark, SF)("fps")
    events = read_table(spark, f"{SF}/events.parquet")
    fps = "cast(CASE WHEN cast(floor(event_id / 600) AS bigint) % 3 = 0 THEN 0 ELSE 3 END AS int)"
    cols = ("user_id % 2 AS device_id", "event_id AS cycle", f"{fps} AS fps")
    got = {(r.device_id, r.cycle, r.reason) for r in run_available(live.stream_watchdog(events.selectExpr(*cols), ttl_ms=None)).collect()}
    want = {(r.device_id, r.cycle, r.reason) for r in win.fps_watchdog(spark.read.parquet(f"{SF}/events.parquet").selectExpr(*cols)).collect()}
    assert got == want and f is not None
