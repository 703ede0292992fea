"""A keyed table that a stream upserts into, exactly: one folder a batch, the newest version of a key on reading."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GONE = "_gone"


@dataclass(frozen=True)
class KeyedTable:
    """Rows by ``keys`` under ``path``, with the columns of ``schema`` (DDL, the keys among them).

    A batch's rows are a folder under ``changes`` named by its id. A batch that is run again replaces its folder, so nothing doubles;
    a row with ``_gone`` takes its key away. :meth:`compact` folds the folders up to a batch into a folder under ``base``, which counts once it is
    complete; reading takes the newest base and the changes after it, of each key the row of the latest batch."""

    path: str
    keys: tuple[str, ...]
    schema: str

    def _columns(self, spark: SparkSession) -> list[str]:
        return spark.createDataFrame([], self.schema).columns

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """``rows`` of a batch, a row a key at most; without a column ``_gone`` all are there."""
        gone = F.coalesce(F.col(GONE), F.lit(False)) if GONE in rows.columns else F.lit(False)
        rows.select(*self._columns(rows.sparkSession), gone.alias(GONE)).write.mode("overwrite").parquet(f"{self.path}/changes/v={int(batch_id)}")

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Ids of the complete folders, sorted: names alone, by Spark's own file system, wherever the table is."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/v=*/_SUCCESS")
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(s.getPath().getParent().getName().removeprefix("v=")) for s in found)

    def _rows(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """All versions that count: of the newest base, and of the changes after it."""
        base = [n for n in self._numbers(spark, "base") if upto is None or n <= upto]
        low = base[-1] if base else -1
        changes = [n for n in self._numbers(spark, "changes") if n > low and (upto is None or n <= upto)]
        folders = [(n, f"{self.path}/base/v={n}") for n in base[-1:]] + [(n, f"{self.path}/changes/v={n}") for n in changes]
        schema = f"{self.schema}, {GONE} boolean"
        if not folders:
            return spark.createDataFrame([], f"{schema}, _v long")
        rows = spark.read.schema(schema).parquet(*(f for _, f in folders))
        # the folder's name tells the batch: one scan, however many folders there are
        return rows.withColumn("_v", F.regexp_extract(F.input_file_name(), "/v=(\\d+)/[^/]*$", 1).cast("long"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, "_v")]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*self.keys, "_r.*")

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as it is now: a row a key."""
        return self._newest(self._rows(spark)).where(~F.col(GONE)).select(*self._columns(spark))

    def compact(self, spark: SparkSession, upto: int | None = None) -> int | None:
        """Fold the changes up to batch ``upto`` (all that are there) into a base, and return its number. The folders that the base
        before this one had replaced are deleted now: a reader that began before this call can go on."""
        changes = [n for n in self._numbers(spark, "changes") if upto is None or n <= upto]
        base = self._numbers(spark, "base")
        if not changes or base and changes[-1] <= base[-1]:
            return base[-1] if base else None
        self._newest(self._rows(spark, changes[-1])).where(~F.col(GONE)).write.mode("overwrite").parquet(f"{self.path}/base/v={changes[-1]}")
        if base:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            for folder in [f"changes/v={n}" for n in changes if n <= base[-1]] + [f"base/v={n}" for n in base[:-1]]:
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
                at.getFileSystem(conf).delete(at, True)
        return changes[-1]
