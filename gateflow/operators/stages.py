"""Tables between the passes of an operator, in the cluster's shared folder: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset a local session, as in tests, gets a
    temporary one; a cluster has no folder that all its machines see by then."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _local_dir()
    return folder.rstrip("/")


@lru_cache(maxsize=None)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="gateflow-")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once and read back."""
    path = f"{shared_dir(df.sparkSession)}/pass-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
