"""Predicates over detections, devices and patrols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filter_confidence(df: DataFrame, thresholds: DataFrame, default: float = 0.6) -> DataFrame:
    """Detections at or above their class's threshold (the highest, if a class has several). Classes are 0 to 15, so at most 16
    rows are broadcast, whatever the table."""
    t = thresholds.where("class_id between 0 and 15").groupBy("class_id").agg(F.max("threshold").alias("threshold"))
    return df.join(F.broadcast(t), "class_id", "left").where(F.col("confidence") >= F.coalesce("threshold", F.lit(default))).drop("threshold")


def filter_min_size(df: DataFrame, side: float = 20.0, width: int = 1920, height: int = 1080) -> DataFrame:
    return df.where((F.col("bbox_width") * width >= side) & (F.col("bbox_height") * height >= side))


def filter_classes(df: DataFrame, classes: tuple[int, ...] = (0, 1, 3)) -> DataFrame:
    return df.where(F.col("class_id").isin(*classes))


def filter_ocr_size(df: DataFrame, least: int = 3000) -> DataFrame:
    """Text crops of too few bytes go; other classes stay."""
    return df.where((F.col("class_id") != 3) | (F.col("size") >= least))


def filter_roi(df: DataFrame, enabled: bool) -> DataFrame:
    """Only what lies in a region, if regions are configured."""
    return df.where(F.coalesce(F.col("roi_name"), F.lit("")) != "") if enabled else df


def eligible_devices(df: DataFrame) -> DataFrame:
    """Devices that a pipeline can run, with the address of their default stream."""
    size = F.size(F.map_filter("stream_uris", lambda _, v: v.isNotNull()))
    uri = F.try_element_at("stream_uris", F.col("default_token"))
    runs = (F.col("source_type") == "file") | ((F.col("source_type") == "rtsp") & F.col("is_online"))
    return df.where(runs & (size > 0)).withColumn("uri", uri).where("uri is not null")


def in_schedule(now: str, valid_from: str = "valid_from", valid_until: str = "valid_until", schedule: str = "schedule") -> Column:
    """Whether ``now`` (``yyyy-MM-dd HH:mm``) is in the range and in one of the day's blocks.

    Ends of the range count, the end of a block does not; no schedule at all is always on."""
    at = F.lit(now).cast("timestamp")
    day, clock = F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "HH:mm")
    begun = F.col(valid_from).isNull() | (F.col(valid_from) <= day)
    open_ = F.col(valid_until).isNull() | (F.col(valid_until) >= day)
    blocks = F.try_element_at(schedule, F.lower(F.date_format(at, "EEE")))
    today = F.coalesce(F.exists(blocks, lambda b: (b[0] <= clock) & (clock < b[1])), F.lit(False))
    return begun & open_ & (F.coalesce(F.size(schedule) <= 0, F.lit(True)) | today)


def prefilter_raw(df: DataFrame, least: float = 0.25, top: int = 300) -> DataFrame:
    """The most confident detections of each frame, above a floor."""
    w = W.partitionBy("source_id", "frame_num").orderBy(F.desc("confidence"), "det_id")
    return df.where(F.col("confidence") >= least).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def search(df: DataFrame, text: str | None, columns: tuple[str, ...], **equal) -> DataFrame:
    """Rows with the text anywhere in one of the columns, whatever the case, and the given values."""
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    if text:
        safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.col(c).ilike(f"%{safe}%")
        df = df.where(hit)
    return df


def with_motion(df: DataFrame, col: str = "status") -> DataFrame:
    return df.withColumn("motion", F.coalesce(F.contains(col, F.lit("VideoMotion")), F.lit(False)))


def runnable_patrols(patrols: DataFrame, devices: DataFrame, now: str) -> DataFrame:
    """Patrols to run now: active, with presets, in schedule, their device online with a user and
    movement; the first of a device."""
    ready = patrols.where(F.col("is_active") & (F.size("preset_order") > 0)).where(in_schedule(now))
    able = devices.where("is_online and username <> '' and ptz").select(F.col("id").alias("device_id"))
    first = W.partitionBy("device_id").orderBy("patrol_id")
    return ready.join(able, "device_id").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def pending_ocr(df: DataFrame) -> DataFrame:
    return df.where((F.col("class_id") == 3) & ~F.coalesce(F.col("ocr_processed"), F.lit(False)))
