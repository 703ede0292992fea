"""Newest rows, pages, tails and unions of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_events(df: DataFrame, device_id: int, n: int = 100) -> DataFrame:
    return df.where(F.col("device_id") == device_id).orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(n)


def page(df: DataFrame, k: int, size: int = 25, order: tuple[str, ...] = ("start_ms", "event_id")) -> DataFrame:
    """Page ``k`` (from 1), newest first, with the total; a page out of range is the last.

    The first ``k`` pages are the top rows, which Spark takes from each partition without a sort of all; where they end early the last
    of them is the last page. The total is a subquery of the same run."""
    k = max(k, 1)
    by = W.orderBy(*(F.desc(c) for c in order))
    top = df.orderBy(*(F.desc(c) for c in order)).limit(k * size).withColumns({"_r": F.row_number().over(by), "_m": F.count("*").over(W.partitionBy())})
    last = F.least(F.lit(k - 1), F.floor((F.col("_m") - 1) / size))
    return top.where(F.floor((F.col("_r") - 1) / size) == last).drop("_r", "_m").withColumn("total", df.agg(F.count("*")).scalar())


def tail_series(df: DataFrame, source: str, n: int = 60) -> DataFrame:
    """The last ``n`` snapshots of a source, oldest first."""
    return df.where(F.col("source") == source).orderBy(F.desc("created_ms"), F.desc("id")).limit(n).orderBy("created_ms", "id")


def overlay_rows(df: DataFrame, now_ms: int, source_id: int | None = None, n: int = 100, within_ms: int = 3000) -> DataFrame:
    d = df.where((F.col("ts_ms") >= now_ms - within_ms) & (F.col("ts_ms") <= now_ms))
    if source_id is not None:
        d = d.where(F.col("source_id") == source_id)
    return d.orderBy(F.desc("ts_ms"), F.desc("det_id")).limit(n)


#: Order in which tables are shown.
DEFAULT_ORDER = {"events": ("start_ms desc", "event_id desc"), "rules": ("device_id", "idx"), "operators": ("name",)}


def in_default_order(df: DataFrame, table: str) -> DataFrame:
    return df.orderBy(*(F.expr(c.removesuffix(" desc")).desc() if c.endswith(" desc") else F.expr(c).asc() for c in DEFAULT_ORDER[table]))


def all_sources(devices: DataFrame) -> DataFrame:
    """Devices that are online, and files, one after the other."""
    cols = ["id", "name", "source_type"]
    return devices.where("source_type = 'rtsp' and is_online").select(*cols).unionByName(devices.where("source_type = 'file'").select(*cols))
