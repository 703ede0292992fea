"""Tables, timelines and messages out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMELINE = ("ts", "event", "src", "truck", "cls", "conf", "ocr", "roi")


def truck_timeline(crossings: DataFrame, entries: DataFrame, cargo: DataFrame) -> DataFrame:
    """CROSS, ROI_IN and CARGO rows under one header of eight columns."""

    def rows(df: DataFrame, event: str) -> DataFrame:
        text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit("")
        return df.select(F.col("ts_ms").alias("ts"), F.lit(event).alias("event"), F.col("source_id").alias("src"), F.col("truck_id").alias("truck"), text("class_id").alias("cls"), text("confidence").alias("conf"), text("ocr_text").alias("ocr"), text("roi_name").alias("roi"))

    return rows(crossings, "CROSS").unionByName(rows(entries, "ROI_IN")).unionByName(rows(cargo, "CARGO"))


def write_truck_csv(timeline: DataFrame, path: str) -> None:
    timeline.select(*TIMELINE).write.option("header", True).csv(path)


def write_detections(df: DataFrame, path: str) -> None:
    """Parquet by date and device."""
    df.withColumn("date", F.to_date(F.timestamp_millis("ts_ms"))).write.partitionBy("date", "device_id").mode("append").parquet(path)


def to_live_message(df: DataFrame, key: str = "device_id") -> DataFrame:
    """(key, value) rows, as a message sink takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def live_sink(stream: DataFrame, path: str | None, checkpoint: str, key: str = "device_id", to: Callable[[DataFrame, int], None] | None = None, form: str = "json", **options):
    """Start sending live messages: by key as files under ``path``, to the sink ``form`` with its ``options`` (a message queue, say) if
    there is no path, or batch by batch to the function ``to``."""
    out = to_live_message(stream, key).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if to is not None:
        return out.foreachBatch(to).start()
    out = out.format(form).options(**options)
    return (out.option("path", path).partitionBy("key") if path else out).start()


def to_api_json(df: DataFrame, ts_col: str = "ts_ms") -> DataFrame:
    """``json``: the row with its time in ISO form."""
    iso = F.date_format(F.timestamp_millis(ts_col), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rest = [c for c in df.columns if c != ts_col]
    return df.select(*rest[:1], F.to_json(F.struct(*rest, iso.alias("timestamp"))).alias("json"))


def nest_frames(df: DataFrame) -> DataFrame:
    """A document for each frame of a source, with its objects in order of their id."""
    o = F.struct(F.col("det_id"), "class_id", "object_id", F.struct(F.col("bbox_left").alias("left"), F.col("bbox_top").alias("top"), F.col("bbox_width").alias("width"), F.col("bbox_height").alias("height")).alias("bbox"))
    frames = df.groupBy("source_id", "frame_num").agg(F.min("ts_ms").alias("timestamp_ms"), F.sort_array(F.collect_list(o)).alias("o"))
    frames = frames.withColumn("objects", F.transform("o", lambda x: F.struct(x.class_id.alias("class_id"), x.object_id.alias("object_id"), x.bbox.alias("bbox"))))
    return frames.select("source_id", "frame_num", F.size("objects").alias("n_objects"), F.to_json(F.struct("source_id", "frame_num", "timestamp_ms", "objects")).alias("document"))
