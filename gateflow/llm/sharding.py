"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, stage


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each 64-bit key among ``n``; all keys jump together until each has landed."""
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    b = np.zeros(len(key), dtype=np.int64)
    while len(live):
        out[live] = b
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        j = ((b + 1).astype(np.float64) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        go = j < n
        live, key, b = live[go], key[go], j[go]
    return out


def jump_shards(df: DataFrame, n_shards: int, key_col: str = "doc_id", shard_col: str = "shard", slot_col: str = "slot", grown_col: str | None = "grown_shard") -> DataFrame:
    """Add shard, gapless slot within the shard, and the shard with one shard more.

    Shard and grown shard depend on the key and the number of shards alone; rows go by their key, so equal texts of different
    keys need not be together. Slots go by the key. Rows are dealt by ranges of (shard, key), each
    task counts its rows of each shard, then the counts of all tasks are summed up; no shard is gathered
    anywhere. The rows pass through stage tables so that a repeated task cannot number them anew.

    Defined edge cases: a null key is key 0; a key that is no integer counts as the 64-bit hash of its text, and a decimal or
    floating one as its text too; rows with equal keys share a shard and have slots of their own, in any order; an empty
    table gives an empty result; all columns of ``df`` are returned, but one named like a new one is replaced by it."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    new = [shard_col, slot_col, *([grown_col] if grown_col else [])]
    kept = {f"__c{i}": c for i, c in enumerate(c for c in df.columns if c not in new)}
    key = F.col(f"`{key_col}`")
    key = key.cast("long") if isinstance(df.schema[key_col].dataType, T.IntegralType) else F.when(key.isNotNull(), F.xxhash64(key.cast("string")))
    rows = df.select(*(F.col(f"`{c}`").alias(k) for k, c in kept.items()), F.coalesce(key, F.lit(0)).alias("__key"))
    sharded = T.StructType([*rows.schema.fields, T.StructField("__shard", T.IntegerType()), T.StructField("__grown", T.IntegerType())])
    numbered = T.StructType([*sharded.fields, T.StructField("__row", T.LongType()), T.StructField("__task", T.IntegerType()), T.StructField("__at", T.LongType())])

    def place(batches):
        for batch in batches:
            keys = batch.column("__key").to_numpy()
            found = [pa.array(jump_hash(keys, n).astype(np.int32)) for n in (n_shards, n_shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "__shard", "__grown"])

    def number(batches):
        from pyspark import TaskContext

        task, counts = TaskContext.get().partitionId(), np.zeros(n_shards, dtype=np.int64)
        for batch in batches:
            shard = batch.column("__shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            of = shard[order]
            rank = np.empty(len(of), dtype=np.int64)
            rank[order] = np.arange(len(of)) - np.searchsorted(of, of)
            at = counts[shard] + rank
            counts += np.bincount(shard, minlength=n_shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), task, dtype=np.int32)), pa.array(at)], numbered.names)

    # a key that many rows have is spread over ranges by the rows' places
    placed = stage(rows.mapInArrow(lean(place), sharded)).withColumn("__row", F.monotonically_increasing_id())
    order = ("__shard", "__key", "__row")
    rows = stage(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(number), numbered))
    sizes = rows.groupBy("__shard", "__task").agg(F.count("*").alias("n"))
    before = F.expr("sum(n) over (partition by __shard order by __task rows between unbounded preceding and 1 preceding)")
    starts = sizes.select("__shard", "__task", F.coalesce(before, F.lit(0)).alias("__start"))
    added = [F.col("__shard").alias(shard_col), (F.col("__start") + F.col("__at")).cast("long").alias(slot_col), *([F.col("__grown").alias(grown_col)] if grown_col else [])]
    return rows.join(starts, ["__shard", "__task"]).select(*(F.col(k).alias(c) for k, c in kept.items()), *added)
