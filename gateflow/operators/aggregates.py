"""Votes, consensus, roll-ups and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import extract_codes, is_valid_code


def seal_vote(det: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Verdict by majority of sealed and unsealed detections, and the winner's share."""
    a, b = F.col("n_sealed"), F.col("n_unsealed")
    votes = det.groupBy(*keys).agg(F.count_if(F.col("class_id") == 0).alias("n_sealed"), F.count_if(F.col("class_id") == 1).alias("n_unsealed"))
    status = F.when(a > b, "con_sello").when(b > a, "sin_sello").otherwise("indeterminado")
    confidence = F.when(a + b == 0, 0.0).when(a == b, 0.5).otherwise(F.greatest(a, b) / F.nullif(a + b, F.lit(0)))
    return votes.withColumns({"seal_status": status, "seal_confidence": confidence})


def avg_color(det: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Mean colour of each group; null with fewer than two coloured rows. Hue is averaged as a plain number."""
    g = det.groupBy(*keys).agg(F.count("color_h").alias("n_colored"), *(F.avg(f"color_{c}").alias(f"color_{c}") for c in "hsv"))
    return g.withColumns({f"color_{c}": F.when(F.col("n_colored") >= 2, F.col(f"color_{c}")) for c in "hsv"})


def code_consensus(det: DataFrame, regions_text: str = "full_text") -> DataFrame:
    """The valid code found most often in an event's processed text detections, of at least two.

    Codes are taken from the joined regions and, if confident, from the main text, each counted; of equally
    frequent codes the one seen first wins, from the newest detection on."""
    d = det.where("class_id = 3 and ocr_processed").withColumn("_n", F.count("*").over(W.partitionBy("event_id"))).where("_n >= 2")
    main = F.when(F.coalesce(F.col("ocr_confidence") >= 0.6, F.lit(False)), extract_codes(F.col("ocr_text")))
    empty = F.array().cast("array<string>")
    codes = F.concat(F.coalesce(extract_codes(F.col(regions_text)), empty), F.coalesce(main, empty))
    c = d.select("event_id", "ts_ms", "det_id", F.posexplode(codes).alias("pos", "code")).where(is_valid_code(F.col("code")))
    seen = F.struct(-F.col("ts_ms"), -F.col("det_id"), "pos")
    n = c.groupBy("event_id", "code").agg(F.count("*").alias("n"), F.min(seen).alias("seen"))
    w = W.partitionBy("event_id").orderBy(F.desc("n"), "seen")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("event_id", F.col("code").alias("container_code"), "n")


def fps_per_source(frames: DataFrame, window_ms: int = 1000) -> DataFrame:
    """Frames per second of each source and tumbling window, halves up; windows without frames have no row."""
    start = (F.floor(F.col("ts_ms") / window_ms) * window_ms).cast("long")
    g = frames.groupBy("source_id", start.alias("window_ms")).agg(F.count("*").alias("n"))
    return g.withColumn("fps", F.floor(F.col("n") / (window_ms / 1000) + 0.5).cast("int"))


def fps_rollup(fps: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Total, sources and mean of each pipeline; zeros if it has no source."""
    g = fps.groupBy("pipeline").agg(F.sum("fps").alias("total_fps"), F.count("*").alias("source_count"), F.bround(F.avg("fps"), 1).alias("avg_fps"))
    return pipelines.join(g, "pipeline", "left").na.fill(0, ["total_fps", "source_count", "avg_fps"])


def container_rollup(df: DataFrame) -> DataFrame:
    """Sums over running containers of each instance and, in the same pass, of each pipeline."""
    on = lambda c: F.sum(F.when(F.col("running"), F.col(c)).otherwise(0))
    g = df.rollup("pipeline", "instance").agg(on("cpu").alias("cpu"), on("mem").alias("mem"), on("pids").alias("pids"), F.count_if(F.col("running")).alias("n_running"), F.countDistinct("instance").alias("n_instances"), F.grouping_id().alias("level"))
    return g.where("level < 3").withColumn("state", F.when(F.col("n_running") > 0, "running").otherwise("stopped"))


def event_summary(det: DataFrame) -> DataFrame:
    return det.groupBy("event_id").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_set(F.col("source_id").cast("string"))), ",").alias("cameras"),
        F.array_join(F.sort_array(F.collect_set(F.col("class_id").cast("string"))), ",").alias("classes"),
    )


def image_hsv(pixels: DataFrame, least: int = 100) -> DataFrame:
    """Mean hue, saturation and value of each image over pixels that are neither dark, blown out nor grey;
    null if there are fewer than ``least``. Where channels tie, blue comes before green before red."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    safe = F.nullif(delta, F.lit(0.0))
    hue = F.when(b == top, (r - g) / safe + 4).when(g == top, (b - r) / safe + 2).otherwise((g - b) / safe % 6)
    hue = hue / 6
    p = pixels.withColumns({"h": F.when(hue < 0, hue + 1).otherwise(hue), "s": delta / F.nullif(top, F.lit(0.0)), "v": top, "d": delta})
    p = p.where("v > 0.15 and v < 0.95 and d > 0.02")
    means = p.groupBy("image").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "hsv"))
    out = pixels.select("image").distinct().join(means, "image", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("image", "n", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in "hsv"))


def image_hsv_files(images: DataFrame, least: int = 100) -> DataFrame:
    """The same of decoded images, as Spark's image source reads them (blue, green, red bytes)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for origin, data, channels in zip(batch["origin"], batch["data"], batch["nChannels"], strict=True):
                px = np.frombuffer(data, dtype=np.uint8).reshape(-1, int(channels))[:, :3] / 255.0
                b, g, r = px.T
                top, delta = px.max(axis=1), px.max(axis=1) - px.min(axis=1)
                ok = (top > 0.15) & (top < 0.95) & (delta > 0.02)
                b, g, r, top, delta = (x[ok] for x in (b, g, r, top, delta))
                h = np.select([b == top, g == top], [(r - g) / delta + 4, (b - r) / delta + 2], np.fmod((g - b) / delta, 6)) / 6
                h = np.where(h < 0, h + 1, h)
                few = len(top) < least
                rows.append((origin, len(top), *((None,) * 3 if few else (h.mean(), (delta / top).mean(), top.mean()))))
            yield pd.DataFrame(rows, columns=["image", "n", "h", "s", "v"])

    return images.select("image.origin", "image.data", "image.nChannels").mapInPandas(run, "image string, n long, h double, s double, v double")


def best_crop(df: DataFrame, window_ms: int = 10_000) -> DataFrame:
    """The most confident crop of each device, object and tumbling window, the first of equals."""
    start = (F.floor(F.col("ts_ms") / window_ms) * window_ms).cast("long")
    best = F.max_by(F.struct("det_id", "confidence"), F.struct("confidence", -F.col("det_id")))
    g = df.groupBy("device_id", "object_id", start.alias("window_ms")).agg(best.alias("b"))
    return g.select("device_id", "object_id", "window_ms", "b.det_id", "b.confidence")


def overcrowding(df: DataFrame, n: int = 3) -> DataFrame:
    g = df.where("roi_name <> ''").groupBy("source_id", "frame_num", "roi_name").agg(F.count("*").alias("n"))
    return g.where(F.col("n") > n)


def pivot_series(df: DataFrame, pipelines: list[str]) -> DataFrame:
    """A row a time with a column a pipeline; null where it said nothing."""
    return df.groupBy("tick").pivot("pipeline", pipelines).agg(F.sum("fps"))


def frame_flags(df: DataFrame, n: int = 3) -> DataFrame:
    """Of each frame: whether an object is in a region, at the exit, or has crossed a line (``crossed``), and whether some region
    has more than ``n`` objects."""
    regions = df.groupBy("source_id", "frame_num", "roi_name").agg(F.bool_or("crossed").alias("crossed"), F.count("*").alias("c"))
    inside = F.col("roi_name") != ""
    return regions.groupBy("source_id", "frame_num").agg(
        F.bool_or(inside).alias("any_roi"), F.bool_or(F.col("roi_name") == "salida").alias("any_exit"), F.bool_or("crossed").alias("any_crossing"), F.bool_or(inside & (F.col("c") > n)).alias("crowded")
    )


def outcome_tally(df: DataFrame) -> DataFrame:
    """Of a job over devices: done, skipped for want of a user, failed."""
    skipped = F.coalesce(F.col("username"), F.lit("")) == ""
    return df.agg(F.count_if(~skipped & F.col("ok")).alias("n_ok"), F.count_if(skipped).alias("n_skipped"), F.count_if(~skipped & ~F.col("ok")).alias("n_error"))
