"""Figures of hosts, containers, media servers and network devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "system": "cpu struct<percent:double,load_1m:double>, memory struct<percent:double,used_mb:double,total_mb:double>, gpu struct<available:boolean,gpus:array<struct<gpu_utilization_pct:double,memory_used_mb:double,memory_total_mb:double,temperature_c:double>>>, disk struct<partitions:array<struct<mountpoint:string,percent:double,free_gb:double>>>",
    "mediamtx": "paths array<struct<name:string,online:boolean,readers:array<int>,bytes_received:long>>, rtsp_sessions array<struct<id:string,rtp_packets_lost:long,rtp_packets_jitter:double>>, webrtc_sessions array<struct<id:string,rtp_packets_lost:long,rtp_packets_jitter:double>>",
    "snmp": "devices array<struct<id:int,name:string,description:string,uptime:string>>",
    "deepstream": "containers map<string,struct<running:boolean,cpu_percent:double,memory_mb:double,network_rx_mb:double,pids:long>>, fps map<string,struct<total_fps:long,source_count:long>>",
}


def parse_metrics(df: DataFrame, source: str) -> DataFrame:
    """Snapshots of one source with their payload as columns."""
    return df.where(F.col("source") == source).withColumn("d", F.from_json("data", SCHEMAS[source])).select("id", "created_ms", "d.*")


def uptime_seconds(ticks: Column) -> Column:
    """Hundredths of a second to whole seconds; null if it is no number."""
    return F.bround(ticks.try_cast("bigint") / 100, 0).cast("long")


def uptime_text(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(seconds % 3600 / 60).cast("string"), F.lit("m")))


def mem_pct(df: DataFrame) -> DataFrame:
    """Memory in MB and as a share of its limit, both with one decimal."""
    mb = lambda c: F.bround(F.col(c) / 1048576, 1)
    return df.withColumns({"mem_mb": mb("mem_bytes"), "mem_pct": F.when(F.col("mem_limit") > 0, F.bround(F.col("mem_bytes") / F.col("mem_limit") * 100, 1)).otherwise(0.0)})


def cpu_pct(df: DataFrame, cpus: int = 4) -> DataFrame:
    """CPU percent from two readings of the container's and the system's counters."""
    own, all_ = F.col("cpu_total") - F.col("cpu_before"), F.col("sys_total") - F.col("sys_before")
    return df.withColumn("cpu_pct", F.when((own > 0) & (all_ > 0), F.bround(own / F.nullif(all_, F.lit(0)) * cpus * 100, 1)).otherwise(0.0))


def system_series(df: DataFrame) -> DataFrame:
    gpu = F.when(F.col("gpu.available"), F.get("gpu.gpus", F.lit(0)))
    return df.select("id", "created_ms", F.col("cpu.percent").alias("cpu"), F.col("memory.percent").alias("ram"), gpu.gpu_utilization_pct.alias("gpu_util"), gpu.memory_used_mb.alias("gpu_mem"), gpu.temperature_c.alias("gpu_temp"))


def system_kpis(df: DataFrame) -> DataFrame:
    """Root partition, or the first; first GPU if there is one."""
    parts = F.col("disk.partitions")
    root = F.coalesce(F.get(F.filter(parts, lambda p: p.mountpoint == "/"), F.lit(0)), F.get(parts, F.lit(0)))
    gpu = F.when(F.col("gpu.available"), F.get("gpu.gpus", F.lit(0)))
    return df.select("id", F.col("cpu.percent").alias("cpu"), F.col("cpu.load_1m").alias("load"), F.col("memory.percent").alias("ram"), root.percent.alias("disk_pct"), root.free_gb.alias("disk_free"), gpu.gpu_utilization_pct.alias("gpu_util"), (gpu.memory_used_mb / gpu.memory_total_mb * 100).alias("gpu_mem_pct"))


def all_sessions(df: DataFrame) -> Column:
    """Sessions of both kinds, one after the other."""
    return F.concat(F.coalesce("rtsp_sessions", F.array()), F.coalesce("webrtc_sessions", F.array()))


def stream_kpis(df: DataFrame) -> DataFrame:
    s = df.withColumn("s", all_sessions(df))
    return s.select(
        "id",
        F.size(F.filter("paths", lambda p: F.coalesce(p.online, F.lit(False)))).alias("online"),
        F.size("paths").alias("total"),
        F.aggregate("paths", F.lit(0), lambda a, p: a + F.greatest(F.lit(0), F.coalesce(F.size(p.readers), F.lit(0)))).alias("readers"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.rtp_packets_lost, F.lit(0))).alias("lost"),
        F.aggregate("s", F.lit(0.0), lambda a, x: F.greatest(a, F.coalesce(x.rtp_packets_jitter, F.lit(0.0)))).alias("jitter"),
    )


def pipeline_kpis(df: DataFrame) -> DataFrame:
    fps, boxes = F.map_values("fps"), F.map_values("containers")
    total = lambda arr, f, zero: F.aggregate(arr, F.lit(zero).cast("double"), lambda a, x: a + F.coalesce(f(x), F.lit(0)))
    return df.select(
        "id", total(fps, lambda x: x.total_fps, 0).alias("fps"), total(fps, lambda x: x.source_count, 0).alias("sources"),
        F.size(F.filter(boxes, lambda c: c.running)).alias("running"), F.size(boxes).alias("instances"),
        total(boxes, lambda c: c.cpu_percent, 0).alias("cpu"), total(boxes, lambda c: c.memory_mb, 0).alias("mem"),
        total(boxes, lambda c: c.network_rx_mb, 0).alias("net"), total(boxes, lambda c: c.pids, 0).alias("pids"),
    )


def flatten_streams(df: DataFrame) -> DataFrame:
    """A row for each path: readers counted, MB received, defaults for what is missing."""
    p = df.select("id", F.explode("paths").alias("p"))
    return p.select("id", "p.name", F.coalesce("p.online", F.lit(False)).alias("online"), F.greatest(F.lit(0), F.coalesce(F.size("p.readers"), F.lit(0))).alias("readers_count"), F.bround(F.coalesce("p.bytes_received", F.lit(0)) / 1048576, 1).alias("mb"))


def flatten_sessions(df: DataFrame) -> DataFrame:
    """A row for each session of either kind, its id cut to 12 characters."""
    s = df.select("id", F.explode(all_sessions(df)).alias("s"))
    return s.select("id", F.substring("s.id", 1, 12).alias("session"), F.coalesce("s.rtp_packets_lost", F.lit(0)).alias("lost"), F.coalesce("s.rtp_packets_jitter", F.lit(0.0)).alias("jitter"))


def snmp_rows(df: DataFrame) -> DataFrame:
    blank = lambda c: F.when(~c.isin("", "(none)"), c)
    r = df.select("id", F.explode("devices").alias("v")).withColumn("n", blank(F.col("v.name")))
    up = uptime_seconds(F.col("v.uptime"))
    return r.select("id", F.col("v.id").alias("device_id"), F.coalesce("n", blank(F.col("v.description"))).alias("name"), F.col("n").isNotNull().alias("reachable"), up.alias("uptime_s"), uptime_text(up).alias("uptime"))


def stream_profiles(devices: DataFrame, uris: str = "stream_uris", id_col: str = "id", ptz: str = "ptz") -> DataFrame:
    """(id, token, name, uri, ptz, is_default) of each address that a device has stored; the default is the first one."""
    keys = F.map_keys(uris)
    d = devices.select(id_col, F.col(ptz).alias("ptz"), F.get(keys, F.lit(0)).alias("_first"), F.explode(uris).alias("token", "uri"))
    return d.select(id_col, "token", F.col("token").alias("name"), "uri", F.coalesce("ptz", F.lit(False)).alias("ptz"), (F.col("token") == F.col("_first")).alias("is_default"))
