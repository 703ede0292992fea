"""Steps that used to gather what grows with the input in one task, one group or one batch."""

import glob

import pytest
from pyspark.sql import functions as F

from gateflow.operators import joins as jn
from gateflow.plans import registry, stream_queries
from gateflow.plans.fixtures import Views
from gateflow.sources import packets
from gateflow.streaming import run

SF = "/root/testdata/sf0.001"


def test_escalations_of_one_task_are_spread(spark):
    incidents = spark.range(0, 2000, 1, 1).selectExpr("id AS incident_id", "0L AS site_id", "id % 100 AS age_s")
    bounds = spark.createDataFrame([(0, 1, 0, 50), (0, 2, 50, None)], "site_id long, level long, from_s long, to_s long")
    operators = spark.range(0, 20, 1, 1).selectExpr("id AS operator_id", "0L AS site_id", "1 + id % 2 AS level")
    out = jn.escalate(incidents, bounds, operators)
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(per_task) == 2000 * 10
    assert len(per_task) == 4 and max(per_task) < 2000 * 10 / 2


@pytest.mark.parametrize("name", ["str1_stream_events", "str2_stream_truck_gate", "str4_stream_watchdog", "str6_stream_map", "str7_preset_filter", "str9_stream_roi"])
def test_streams_in_small_batches_have_the_same_rows(spark, monkeypatch, name):
    whole = [tuple(r) for r in registry.queries()[name](spark, SF).collect()]
    monkeypatch.setattr(run, "BATCH_ROWS", 300)
    seen = []
    monkeypatch.setattr(stream_queries, "in_order", lambda df, by: seen.append(run.in_order(df, by)) or seen[-1])
    got = [tuple(r) for r in registry.queries()[name](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(whole, key=repr)
    sizes = [spark.read.parquet(f).count() for f in glob.glob(f"{seen[0]}/*.parquet")]
    assert len(seen) == 1 and len(sizes) >= 3 and max(sizes) <= 450 and sum(sizes) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_packing_starts_no_group_for_a_capture(spark):
    rows = Views(spark, SF)("detections").selectExpr("concat('p', object_id) AS path", "cast(row_number() OVER (PARTITION BY object_id ORDER BY det_id) AS int) AS pos", "device_id", "source_id", "class_id", "object_id", "confidence", "bbox_left", "bbox_top", "bbox_width", "bbox_height", "frame_num", "ts_ms", "cast(1 AS bigint) AS size", "cast('x' AS binary) AS image")
    plan = packets.encode_packets(rows, "crop")
    assert "MapInArrow" in plan._jdf.queryExecution().toString() and "FlatMapGroupsInArrow" not in plan._jdf.queryExecution().toString()
    assert packets.decode_crop_packets(plan).count() == rows.count() and plan.count() == rows.select("path").distinct().count()


def test_escalations_send_no_table_through_the_driver(spark):
    incidents = spark.range(0, 3000, 1, 1).selectExpr("id AS incident_id", "id % 3 AS site_id", "id % 200 AS age_s")
    bounds = spark.range(0, 3000, 1, 1).selectExpr("id % 3 AS site_id", "cast(1 + floor(id / 3) AS int) AS level", "50 * floor(id / 3) AS from_s", "50 * (1 + floor(id / 3)) AS to_s")
    # other types than the levels', more operators than one array takes (2^14), one without a number
    operators = spark.range(0, 2**14 + 900, 1, 1).selectExpr("nullif(id, 7) AS operator_id", "cast(0 AS int) AS site_id", "CASE WHEN id % 40 = 7 THEN 2L ELSE 9L END AS level")
    out = jn.escalate(incidents, bounds, operators)
    pairs = incidents.where("site_id = 0 and age_s >= 50 and age_s < 100").crossJoin(operators.where("level = 2"))
    assert sorted(out.select("incident_id", "operator_id").collect(), key=repr) == sorted(pairs.select("incident_id", "operator_id").collect(), key=repr)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    # each side keeps its partitions: types that differ would make Spark shuffle it again, into few
    assert out.groupBy(F.spark_partition_id()).count().count() == 4


def test_escalations_of_large_levels_are_cut_into_slices(spark, monkeypatch):
    incidents = spark.range(0, 200, 1, 1).selectExpr("id AS incident_id", "id % 2 AS site_id", "id % 90 AS age_s")
    bounds = spark.createDataFrame([(0, 1, 0, 50), (0, 2, 50, None), (1, 1, 0, None)], "site_id long, level long, from_s long, to_s long")
    operators = spark.range(0, 700, 1, 1).selectExpr("nullif(id, 7) AS operator_id", "CASE WHEN id % 9 = 1 THEN 1L ELSE 0L END AS site_id", "CASE WHEN id % 11 = 1 THEN 2L ELSE 1L END AS level")
    whole = sorted(map(tuple, jn.escalate(incidents, bounds, operators).collect()), key=repr)
    monkeypatch.setattr(jn, "ESCALATE_SLICE", 100)
    out = jn.escalate(incidents, bounds, operators)
    assert sorted(map(tuple, out.collect()), key=repr) == whole and len(whole) > 20000
    # all levels take as many slices as the largest needs
    assert "sequence(0, 5" in out._jdf.queryExecution().analyzed().toString()
