"""As-of joins: both sides in one ordered run, and no pairs.

Rows and probes are one table in order of time. A probe takes the last row before it by a window over a time span; what was last
before the span comes from a table with a row a lane and span. So a lane of any density makes as many rows as went in, and one that holds
half of all rows is spread over its spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lanes import SPAN_MS, before_span


def last_before(probes: DataFrame, rows: DataFrame, keys: tuple[str, ...], at: str, order: tuple[str, ...], name: str, strict: bool = False, span_ms: int = SPAN_MS) -> DataFrame:
    """``probes`` with ``name``: the whole last row (a struct) of ``rows`` with its keys at or before its time ``at`` (with ``strict``:
    before), or null. ``order`` sorts ``rows``, the time first. Null keys are keys; rows and probes without a time find nothing."""
    kept = {f"__p{i}": c for i, c in enumerate(probes.columns)}
    key = lambda df: [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    row = F.struct(*(F.col(f"`{c}`") for c in [*order, *(c for c in rows.columns if c not in order)]))
    right = rows.where(F.col(f"`{order[0]}`").isNotNull()).select(*key(rows), F.col(f"`{order[0]}`").cast("long").alias("__at"), F.lit(1 if strict else -1).alias("__kind"), row.alias("__row"))
    left = probes.select(*key(probes), F.col(f"`{at}`").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.struct(*(F.col(f"`{c}`").alias(k) for k, c in kept.items())).alias("__probe"))
    both = right.unionByName(left, allowMissingColumns=True).withColumn("_span", F.floor(F.col("__at") / span_ms))
    lane = tuple(f"__k{i}" for i in range(len(keys)))
    # rows are structs that begin with their order, so the greatest is the last
    both = before_span(both, lane, {"__old": F.max("__row")}, {"__old": F.max})
    w = W.partitionBy(*lane, "_span").orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn(name, F.coalesce(F.max("__row").over(w), F.col("__old"))).where("__kind = 0")
    return found.select(*(F.col(f"__probe.{k}").alias(c) for k, c in kept.items()), F.when(F.col("__at").isNotNull(), F.col(name)).alias(name))


def first_after(probes: DataFrame, rows: DataFrame, keys: tuple[str, ...], at: str, ts: str, name: str, strict: bool = False, span_ms: int = SPAN_MS) -> DataFrame:
    """``probes`` with ``name``: the first row of ``rows`` with its keys at or after its time ``at`` (with ``strict``: after). Rows are sorted by ``ts``,
    then by their other columns in order. Time runs backwards here: see :func:`last_before`."""
    rest = [c for c in rows.columns if c != ts]
    back = rows.select(*(F.col(k) for k in keys), (-F.col(ts)).alias("__ts"), *((-F.col(c)).alias(f"__b{i}") for i, c in enumerate(rest) if c not in keys))
    order = ("__ts", *(f"__b{i}" for i, c in enumerate(rest) if c not in keys))
    found = last_before(probes.withColumn("__neg", -F.col(at)), back, keys, "__neg", order, name, strict, span_ms)
    fields = [(-F.col(f"{name}.__ts")).alias(ts), *((-F.col(f"{name}.__b{i}")).alias(c) for i, c in enumerate(rest) if c not in keys)]
    return found.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(*fields))).drop("__neg")
