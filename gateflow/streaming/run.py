"""Reading tables as streams, and running a stream over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.stages import shared_dir, stage


def read_table(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files, at most so many a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file


#: Rows of a batch, about: a batch's rows of a key are one group of a fold, and a hot key has many of them.
BATCH_ROWS = 1 << 22


def in_order(df: DataFrame, by: str) -> str:
    """A folder with the rows of ``df`` in files of about ``BATCH_ROWS`` rows in order of the number ``by``, written one after the other, so that
    ``read_table(..., files_per_trigger=1)`` is a stream that brings them in this order. Rows of one value stand in one file, nulls in the first. The
    file system must tell times of files that are written a fraction of a second apart."""
    root = f"{shared_dir(df.sparkSession)}/in-order-{uuid.uuid4().hex}"
    parts = -(-df.count() // BATCH_ROWS)
    cuts = sorted(set(df.stat.approxQuantile(by, [k / parts for k in range(1, parts)], 0.002))) if parts > 1 else []
    ranged = stage(df.repartitionByRange(by).sortWithinPartitions(by))  # a file's rows are then read from few others
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = ranged if low is None else ranged.where(F.col(by) >= low)
        part = part if high is None else part.where((F.col(by) < high) | F.col(by).isNull())
        part.repartition(1).write.mode("append").option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(root)
    return root


def run_available(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its rows as a table."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(output_mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_updates(stream: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Run an aggregation over what is there now and return the last row of each key. Rows are taken as they are
    updated, so that the last windows are told as well, which in append mode wait for a later row."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    save = lambda batch, k: batch.withColumn("_batch", F.lit(k)).write.mode("overwrite").parquet(f"{root}/out/_n={k}")  # noqa: E731  a batch that is run again replaces itself
    q = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(f"{root}/out")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def run_complete(stream: DataFrame) -> DataFrame:
    """Run an aggregation over what is there now and return all its rows, as they are after the last batch."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def save(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/n={k}")
        last[:] = [k]

    q = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/n={last[0]}") if last else spark.createDataFrame([], stream.schema)
