"""Messages, configuration texts and registry tables to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOX = "struct<left:double,top:double,width:double,height:double>"
DETECTION = f"device_id int, source_id int, frame_num long, timestamp_ms long, objects array<struct<class_id:int,object_id:long,truck_id:long,confidence:double,bbox:{_BOX}>>"
DETECTION_V2 = "source_id int, frame_num long, ts long, objects array<struct<cls:int,truck:long,conf:double,bbox:array<double>>>"
TRUCK = f"event string, source_id int, truck_id long, timestamp_ms long, roi_name string, bbox {_BOX}, cargo array<struct<class_id:int,confidence:double>>"


def _strict(col: str, schema: str) -> Column:
    """The parsed message; null if it is malformed anywhere."""
    marked = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    return F.from_json(col, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def parse_detections(df: DataFrame, col: str = "body") -> DataFrame:
    """One row an object. Messages that are malformed, or lack a device or a time (null or 0), are dropped."""
    m = df.select(_strict(col, DETECTION).alias("m")).where("m is not null and m._bad is null and m.device_id <> 0 and m.timestamp_ms <> 0")
    o = m.select("m.device_id", "m.source_id", "m.frame_num", F.col("m.timestamp_ms").alias("ts_ms"), F.explode_outer("m.objects").alias("o"))
    return o.select("device_id", "source_id", "frame_num", "ts_ms", "o.class_id", "o.object_id", "o.truck_id", "o.confidence", *(F.col(f"o.bbox.{k}").alias(f"bbox_{k}") for k in ("left", "top", "width", "height")))


def parse_detections_v2(df: DataFrame, col: str = "body") -> DataFrame:
    """The other message form, as rows of the first; it has no device and no object id."""
    m = df.select(_strict(col, DETECTION_V2).alias("m")).where("m is not null and m._bad is null")
    o = m.select("m.source_id", "m.frame_num", F.col("m.ts").alias("ts_ms"), F.explode_outer("m.objects").alias("o"))
    box = ("left", "top", "width", "height")
    return o.select(F.lit(-1).alias("device_id"), "source_id", "frame_num", "ts_ms", F.col("o.cls").alias("class_id"), F.lit(None).cast("long").alias("object_id"), F.col("o.truck").alias("truck_id"), F.col("o.conf").alias("confidence"), *(F.get("o.bbox", F.lit(k)).alias(f"bbox_{c}") for k, c in enumerate(box)))


def parse_truck_events(df: DataFrame, col: str = "body") -> DataFrame:
    """One row a piece of cargo, or one without cargo."""
    m = df.select(_strict(col, TRUCK).alias("m")).where("m is not null and m._bad is null")
    c = m.select("m.event", "m.source_id", "m.truck_id", F.col("m.timestamp_ms").alias("ts_ms"), "m.roi_name", F.explode_outer("m.cargo").alias("c"))
    return c.select("event", "source_id", "truck_id", "ts_ms", "roi_name", F.col("c.class_id").alias("cargo_class"), F.col("c.confidence").alias("cargo_confidence"))


def parse_camera_events(df: DataFrame, col: str = "line") -> DataFrame:
    """code, action (``Unknown``), index (0) and data (empty) of event lines; lines without a code are dropped."""
    part = lambda key: F.nullif(F.regexp_extract(col, f"(?:^|;){key}=([^;]*)", 1), F.lit(""))
    rows = df.withColumns({
        "code": part("Code"),
        "action": F.coalesce(part("action"), F.lit("Unknown")),
        "index": F.coalesce(part("index").try_cast("int"), F.lit(0)),
        "data": F.coalesce(F.from_json(F.regexp_extract(col, "(?s)(?:^|;)data=(.*)$", 1), "map<string,string>"), F.create_map().cast("map<string,string>")),
    })
    return rows.where("code is not null")


def parse_config_table(df: DataFrame, col: str = "body", key: str = "device_id") -> DataFrame:
    """(device, path, indices, field, value) of lines like ``table.A[0].B[1].C=v``; other lines are dropped."""
    lines = df.select(key, F.explode(F.split(col, "\r?\n")).alias("line"))
    lines = lines.where(F.rlike("line", F.lit(r"^table\.[^=]+=")))
    full = F.regexp_extract("line", r"^table\.([^=]+)=", 1)
    rows = lines.select(key, full.alias("full"), F.regexp_extract("line", r"^table\.[^=]+=(.*)$", 1).alias("value"))
    bare = F.regexp_replace("full", r"\[[0-9]+\]", "")
    return rows.select(
        key,
        F.regexp_replace(bare, r"\.?[^.]*$", "").alias("path"),
        F.transform(F.regexp_extract_all("full", F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda i: i.cast("int")).alias("indices"),
        F.regexp_extract(bare, r"([^.]*)$", 1).alias("field"),
        "value",
    )


def ivs_rules(config: DataFrame, key: str = "device_id", path: str = "VideoAnalyseRule") -> DataFrame:
    """A row for each rule of a device: the last index is the rule's; missing fields get defaults."""
    rows = config.where((F.col("path") == path) & (F.size("indices") > 0)).withColumn("index", F.element_at("indices", -1))
    fields = ["Name", "Type", "Enable", "Direction"]
    wide = rows.groupBy(key, "index").pivot("field", fields).agg(F.first("value"))
    return wide.select(
        key, "index",
        F.coalesce("Name", F.concat(F.lit("Rule "), F.col("index").cast("string"))).alias("name"),
        F.coalesce("Type", F.lit("")).alias("rule_type"),
        F.coalesce(F.lower("Enable") == "true", F.lit(False)).alias("enable"),
        F.coalesce("Direction", F.lit("Both")).alias("direction"),
    )


def parse_ini_rows(df: DataFrame, col: str = "body", key: str = "file_id") -> DataFrame:
    """(section, key, values, line): blank and ``#`` lines skipped, values split at ``;``, repeated keys kept.

    The section of a line is found inside its own file, which is one row, so nothing is shuffled."""
    lines = F.transform(F.split(col, "\r?\n"), lambda t, i: F.struct(F.trim(t).alias("t"), i.alias("i")))
    head = lambda x: F.rlike(x.t, F.lit(r"^\[.*\]$"))
    rows = df.select(key, lines.alias("lines")).select(key, F.filter("lines", head).alias("heads"), F.explode("lines").alias("x"))
    section = F.get(F.filter("heads", lambda h: h.i < F.col("x.i")), F.size(F.filter("heads", lambda h: h.i < F.col("x.i"))) - 1).t
    rows = rows.where("x.t <> '' and not startswith(x.t, '#') and contains(x.t, '=')").where(~head(F.col("x")))
    name, value = F.substring_index("x.t", "=", 1), F.expr("substring(x.t, instr(x.t, '=') + 1)")
    values = F.filter(F.transform(F.split(value, ";"), lambda t: F.trim(t)), lambda v: v != "")
    return rows.select(key, F.regexp_replace(section, r"^\[|\]$", "").alias("section"), F.trim(name).alias("key"), values.alias("values"), F.col("x.i").alias("line"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, threshold) of ``class=value`` lines; classes 0 to 15 with a positive value."""
    rows = spark.read.option("sep", "=").schema("class_id int, threshold double").csv(path)
    return rows.where("class_id between 0 and 15 and threshold > 0")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, label) of a text file with a label a line, or with ``;`` between them."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "[\r\n;]+"), lambda t: F.trim(t)), lambda t: t != "")).alias("class_id", "label"))


def scan_crops(files: DataFrame, col: str = "path") -> DataFrame:
    """Ids and date from crop file names ``.../YYYY/MM/DD/dev1_src0_cls3_obj5_1000.jpg``; other files are dropped."""
    pattern = r"(\d{4})/(\d{2})/(\d{2})/dev(-?\d+)_src(\d+)_cls(\d+)_obj(\d+)_(\d+)\.jpg$"
    part = lambda k: F.regexp_extract(col, pattern, k)
    rows = files.where(F.rlike(col, F.lit(pattern)))
    return rows.select(col, F.concat_ws("-", part(1), part(2), part(3)).alias("date"), part(4).cast("int").alias("device_id"), part(5).cast("int").alias("source_id"), part(6).cast("int").alias("class_id"), part(7).cast("long").alias("object_id"), part(8).cast("long").alias("ts_ms"))


def load_table(spark: SparkSession, name: str, root: str | None = None, jdbc_url: str | None = None, **options) -> DataFrame:
    """A registry table from Parquet under ``root`` or through JDBC."""
    if jdbc_url:
        return spark.read.format("jdbc").options(url=jdbc_url, dbtable=name, **options).load()
    return spark.read.parquet(f"{root}/{name}.parquet")


def parse_source_map(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_id, device_id) of plain keys, and the attributes of ``n:attr`` keys, a column each."""
    plain = df.where(~F.contains("key", F.lit(":"))).select(F.col("key").cast("int").alias("source_id"), F.col("value").cast("int").alias("device_id"))
    rest = df.where(F.contains("key", F.lit(":"))).select(F.split("key", ":")[0].cast("int").alias("source_id"), F.split("key", ":")[1].alias("attr"), "value")
    return plain, rest.groupBy("source_id").pivot("attr", ["camera_id", "url", "fps"]).agg(F.first("value"))
