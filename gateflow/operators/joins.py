"""Containment, regions, as-of, nearest, and table maintenance joins.

No join here is a cross or nested-loop join: spatial conditions ride on an equality (frame), and as-of
joins are windows over the union of both sides. Small tables are left to
Spark's own size check; only tables whose size is fixed or checked are broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import hsv_distance, inside_polygon
from .asof import last_before
from .stages import stage


def map_sources(df: DataFrame, source_map: DataFrame) -> DataFrame:
    """device_id of each source, -1 where unmapped."""
    return df.drop("device_id").join(source_map, "source_id", "left").withColumn("device_id", F.coalesce("device_id", F.lit(-1)))


def require_device(df: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known devices, and the rest for quarantine."""
    known = devices.select(F.col("id").alias("device_id")).distinct()
    return df.join(known, "device_id", "left_semi"), df.join(known, "device_id", "left_anti")


def contain_join(cargo: DataFrame, trucks: DataFrame, mode: str = "first") -> DataFrame:
    """Cargo whose centre is in a truck's box (edges count) of the same source and frame: in the ``first``
    truck in frame order, or in ``all`` of them."""
    keys = ["source_id", "frame_num"]
    t = trucks.select(*keys, "truck_det", "truck_id", *(F.col(f"bbox_{c}").alias(f"t_{c}") for c in ("left", "top", "width", "height")))
    cx, cy = F.col("bbox_left") + F.col("bbox_width") / 2, F.col("bbox_top") + F.col("bbox_height") / 2
    inside = cx.between(F.col("t_left"), F.col("t_left") + F.col("t_width")) & cy.between(F.col("t_top"), F.col("t_top") + F.col("t_height"))
    hits = cargo.join(t, keys).where(inside).drop("t_left", "t_top", "t_width", "t_height")
    if mode == "all":
        return hits
    w = W.partitionBy("det_id").orderBy("truck_det")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_presets(presets: DataFrame) -> DataFrame:
    """Of each device the preset stored last."""
    return presets.groupBy("device_id").agg(F.max_by("shapes", "preset_id").alias("shapes"))


def roi_of(det: DataFrame, shapes: str) -> DataFrame:
    """``roi_name``: the first closed polygon of the row's ``shapes`` with the centre strictly inside; empty if there is none."""
    closed = F.filter(shapes, lambda s: F.coalesce(s.isClosed, F.lit(True)) & (F.size(s.points) >= 3))
    cx, cy = F.col("bbox_left") + F.col("bbox_width") / 2, F.col("bbox_top") + F.col("bbox_height") / 2
    hit = F.filter(closed, lambda s: inside_polygon(cx, cy, s.points))
    return det.withColumn("roi_name", F.coalesce(F.get(hit, F.lit(0)).getField("name"), F.lit("")))


def roi_join(det: DataFrame, presets: DataFrame) -> DataFrame:
    """:func:`roi_of` the device's last preset. A device's shapes are one array, so a detection stays one row."""
    p = last_presets(presets).select("device_id", F.col("shapes").alias("_shapes"))
    return roi_of(det.join(p, "device_id", "left"), "_shapes").drop("_shapes")


def resolve_preset(devices: DataFrame, presets: DataFrame) -> DataFrame:
    """The preset of the device's token if it has shapes, else ``__fixed__``, if that has any."""
    own = presets.where(F.size("shapes") > 0).select("device_id", F.col("preset_token").alias("active_token"), F.col("preset_id").alias("own_preset"))
    fixed = presets.where((F.size("shapes") > 0) & (F.col("preset_token") == "__fixed__")).select("device_id", F.col("preset_id").alias("fixed_preset"))
    d = devices.join(own, ["device_id", "active_token"], "left").join(fixed, "device_id", "left")
    return d.withColumn("preset_id", F.coalesce("own_preset", "fixed_preset")).drop("own_preset", "fixed_preset")


def prev_event(events: DataFrame, lane: str = "site_id", within_ms: int = 30_000) -> DataFrame:
    """Of each event the closed event of its lane that ended last before it starts, within the window. An end at the time of
    the start does not count as before.

    Ends and starts are one ordered run (see :mod:`.asof`), so a lane with many events at a time makes no more rows than they are."""
    ends = events.select(lane, "end_ms", "event_id")
    found = last_before(events.select("event_id", lane, "start_ms"), ends, (lane,), "start_ms", ("end_ms", "event_id"), "p", strict=True)
    near = F.col("start_ms") - F.col("p.end_ms") <= within_ms
    return found.select("event_id", F.when(near, F.col("p.event_id")).alias("prev_event_id"), F.when(near, F.col("start_ms") - F.col("p.end_ms")).alias("gap_ms"))


def open_event_at(q: DataFrame, events: DataFrame, within_ms: int = 15_000, lane: str = "site_id") -> DataFrame:
    """Of each row the newest event of its lane that started at most ``within_ms`` before; null if none. Starts and rows are one
    ordered run (see :mod:`.asof`)."""
    starts = events.select(lane, "start_ms", F.col("event_id").alias("open_event_id"))
    found = last_before(q, starts, (lane,), "ts_ms", ("start_ms", "open_event_id"), "_b")
    near = F.col("ts_ms") - F.col("_b.start_ms") <= within_ms
    return found.withColumn("open_event_id", F.when(near, F.col("_b.open_event_id"))).drop("_b")


def event_detail(events: DataFrame, det: DataFrame, event_id: int) -> DataFrame:
    """An event's detections, newest first."""
    e = events.where(F.col("event_id") == event_id).select("event_id", "start_ms", "end_ms")
    return e.join(det.where(F.col("event_id") == event_id), "event_id").orderBy(F.desc("ts_ms"), F.desc("det_id"))


def events_with(events: DataFrame, det: DataFrame, condition: str) -> DataFrame:
    return events.join(det.where(condition).select("event_id"), "event_id", "left_semi")


def distinct_clusters(clusters: DataFrame, threshold: float = 0.25) -> DataFrame:
    """``splittable``: whether two clusters of an event are further apart in colour than the threshold.

    An event has few clusters (of 3 detections at least), so pairs are made inside its one row."""
    c = clusters.where("color_h is not null").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("cluster", "color_h", "color_s", "color_v"))).alias("c"))
    far = F.exists("c", lambda a: F.exists("c", lambda b: (a.cluster < b.cluster) & (hsv_distance((a.color_h, a.color_s, a.color_v), (b.color_h, b.color_s, b.color_v)) > threshold)))
    return clusters.select("event_id").distinct().join(c.select("event_id", far.alias("s")), "event_id", "left").select("event_id", F.coalesce("s", F.lit(False)).alias("splittable"))


def presets_with_snapshot(camera: DataFrame, stored: DataFrame) -> DataFrame:
    j = camera.join(stored.select("device_id", "preset_token", "snapshot"), ["device_id", "preset_token"], "left")
    return j.withColumns({"snapshot": F.coalesce("snapshot", F.lit("")), "preset_name": F.coalesce(F.nullif("preset_name", F.lit("")), F.concat(F.lit("Preset "), F.col("preset_token")))})


def site_roster(sites: DataFrame, levels: DataFrame, operators: DataFrame) -> DataFrame:
    """Of each site the number of levels and its operators' names in order."""
    l = levels.groupBy("site_id").agg(F.count("*").alias("n_levels"))
    o = operators.groupBy("site_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("operators"), F.countDistinct("operator_id").alias("n_operators"))
    return sites.join(l, "site_id", "left").join(o, "site_id", "left").select("site_id", "site_name", F.coalesce("n_levels", F.lit(0)).alias("n_levels"), F.coalesce("n_operators", F.lit(0)).alias("n_operators"), F.coalesce("operators", F.lit("")).alias("operators"))


def replace_rules(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rules of the devices in ``new`` are replaced by its list, numbered by its order."""
    kept = current.join(new.select("device_id"), "device_id", "left_anti")
    number = (F.row_number().over(W.partitionBy("device_id").orderBy("ord")) - 1).cast("long")
    return kept.select("device_id", F.col("idx").cast("long").alias("idx"), "name").unionByName(new.select("device_id", number.alias("idx"), "name"))


def changed_devices(old: DataFrame, new: DataFrame, columns: tuple[str, ...] = ("host", "port", "username", "password"), uris: str = "stream_uris") -> DataFrame:
    """Devices that differ in one of the columns or the map of addresses (in any order), or are new."""
    o = old.select("id", F.struct(*columns).alias("o"), F.sort_array(F.map_entries(uris)).alias("om"))
    n = new.select("id", F.struct(*columns).alias("n"), F.sort_array(F.map_entries(uris)).alias("nm"))
    j = n.join(o, "id", "left")
    return j.where(F.col("o").isNull() | ~F.col("o").eqNullSafe(F.col("n")) | ~F.col("om").eqNullSafe(F.col("nm"))).select("id")


#: Parts that the incidents of a level are dealt over.
ESCALATE_SALTS = 16
#: At most 2 to this power operators stand together in one array.
ESCALATE_PACK_BITS = 14
#: Operators of a level that an incident meets at a time, about.
ESCALATE_SLICE = 2**16


def escalate(incidents: DataFrame, bounds: DataFrame, operators: DataFrame) -> DataFrame:
    """(incident, level, operator): who is called at the incident's age. ``bounds`` (site, level, from_s,
    to_s) are half open, without end for the last level.

    A row comes out for each operator of an incident's level, so the result grows with incidents times operators of a site and level.
    Incidents are dealt over ``ESCALATE_SALTS`` parts, which all levels and operators go to, in a fixed number of
    partitions: small ones would be merged into a task or two that make all rows. All joins are merges, and operators go packed: Spark
    takes each side for small, whatever its rows, and would send it through the driver. A task holds the rows of one incident with
    ``ESCALATE_SLICE`` operators at a time: a larger level (they are counted first) is cut into slices, which its incidents all go to.
    Levels without operators call nobody and are left out first."""
    spark = incidents.sparkSession
    tasks, level = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), ["_site", "_level"]
    keys = [*level, "_slice", "_salt", "_part"]
    part_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_out = lambda df: df.withColumn("_part", F.xxhash64(*level, "_slice", "_salt")).repartition(tasks, "_part")  # noqa: E731  # of one type on both sides, and no constant: else the merge shuffles again
    called = operators.select(F.col("site_id").alias("_site"), F.col("level").alias("_level"), "operator_id")
    slices = -(-(called.groupBy(*level).count().agg(F.max("count")).first()[0] or 1) // ESCALATE_SLICE)
    b = bounds.select("site_id", "level", "from_s", "to_s").join(called.select(*level).distinct().hint("merge"), F.expr("site_id = _site and level = _level"))
    b = b.withColumn("_salt", all_of(ESCALATE_SALTS)).hint("merge")
    at = incidents.withColumn("_salt", part_of("incident_id", ESCALATE_SALTS)).join(b, ["site_id", "_salt"]).where("age_s >= from_s and (to_s is null or age_s < to_s)")
    at = at.withColumn("_slice", all_of(slices))
    # a list leaves out nulls, a list of arrays doesn't
    packs = called.groupBy(*level, part_of("operator_id", slices).alias("_slice"), F.shiftright(F.monotonically_increasing_id(), ESCALATE_PACK_BITS)).agg(F.flatten(F.collect_list(F.array("operator_id"))).alias("_pack"))
    packs = packs.select(*level, "_slice", "_pack", all_of(ESCALATE_SALTS).alias("_salt"))
    return dealt_out(at).join(dealt_out(packs).hint("merge"), keys).select("*", F.explode("_pack").alias("operator_id")).drop(*keys, "_pack")


def pair_score(det: DataFrame, iou_weight: float = 0.6, size_weight: float = 0.4) -> DataFrame:
    """Boxes of one class in consecutive frames of a source paired one to one, greedily by score: (det_id, prev_det, score).

    score = 0.6 * overlap + 0.4 * likeness of size, to 9 places; of equal scores the lower det_id, then prev_det, goes first. Greedy
    matching goes in rounds: pairs that are each other's best among those left are what the greedy order would take
    next, so they are taken all at once, over all frames, until no pair is left."""
    box = ("left", "top", "width", "height")
    a = det.select("source_id", "class_id", (F.col("frame_num") + 1).alias("frame_num"), F.col("det_id").alias("prev_det"), *(F.col(f"bbox_{c}").alias(f"p_{c}") for c in box))
    j = det.select("source_id", "class_id", "frame_num", "det_id", *(f"bbox_{c}" for c in box)).join(a, ["source_id", "class_id", "frame_num"])

    def overlap(low: str, size: str):
        return F.greatest(F.lit(0.0), F.least(F.col(f"bbox_{low}") + F.col(f"bbox_{size}"), F.col(f"p_{low}") + F.col(f"p_{size}")) - F.greatest(F.col(f"bbox_{low}"), F.col(f"p_{low}")))

    area, prev = F.col("bbox_width") * F.col("bbox_height"), F.col("p_width") * F.col("p_height")
    shared = overlap("left", "width") * overlap("top", "height")
    score = iou_weight * shared / (area + prev - shared) + size_weight * F.least(area, prev) / F.greatest(area, prev)
    left = stage(j.select("det_id", "prev_det", F.round(score, 9).alias("score")))
    order = (F.desc("score"), "det_id", "prev_det")
    mine, its = W.partitionBy("det_id").orderBy(*order), W.partitionBy("prev_det").orderBy(*order)
    taken = None
    while True:
        best = left.withColumn("_a", F.row_number().over(mine)).withColumn("_b", F.row_number().over(its)).where("_a = 1 and _b = 1").drop("_a", "_b")
        best = stage(best)
        taken = best if taken is None else taken.unionAll(best)
        left = stage(left.join(best.select("det_id"), "det_id", "left_anti").join(best.select("prev_det"), "prev_det", "left_anti").select("det_id", "prev_det", "score"))
        if left.isEmpty():
            return taken


def upsert(current: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full join by key; of rows in both, the named columns come from ``new``, the others stay."""
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    j = current.join(n, keys, "full_outer")
    return j.select(*keys, *(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns if c not in keys))


def active_preset_name(devices: DataFrame, presets: DataFrame) -> DataFrame:
    p = presets.select("device_id", F.col("preset_token").alias("active_token"), "preset_name")
    return devices.join(p, ["device_id", "active_token"], "left").withColumn("preset_name", F.coalesce("preset_name", F.lit("")))
