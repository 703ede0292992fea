"""Lanes (a site, a source, a device) of rows in time: cut into pieces that are worked on apart, numbered, and folded.

A lane can hold half of all rows, so nothing here gathers one. What a row needs to know of the lane before it comes from
a small table with a row for each lane and time span, over which the running values are made; inside a span it
is a window over the span alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPAN_MS = 3_600_000


def before_span(df: DataFrame, keys: tuple[str, ...], values: dict[str, Column], running: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with running values over the spans before its own: ``values`` are aggregates of a span, ``running`` of
    the spans' values."""
    at = [*keys, "_span"]
    w = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = df.groupBy(*at).agg(*(v.alias(c) for c, v in values.items())).select(*(F.col(k).alias(f"_of_{k}") for k in at), *(f(F.col(c)).over(w).alias(c) for c, f in running.items()))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in at]
    return df.join(spans, on, "left").drop(*(f"_of_{k}" for k in at))


def cut(df: DataFrame, keys: tuple[str, ...], ts: str, gap_ms: int, end: str | None = None, at_gap: bool = False, span_ms: int = SPAN_MS) -> DataFrame:
    """``df`` with ``_piece``, the time at which the row's piece begins: where for more than ``gap_ms`` (with ``at_gap``: so
    long or longer) all rows of its lane before have ended, at ``end`` or else at ``ts``."""
    d = df.withColumn("_span", F.floor(F.col(ts) / span_ms))
    ended = F.col(end or ts)
    d = before_span(d, keys, {"_hi": F.max(ended)}, {"_hi": F.max})
    inside = W.partitionBy(*keys, "_span").orderBy(ts)
    last = F.greatest(F.max(ended).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("_hi"))
    gap = F.col(ts) - last
    d = d.withColumn("_cut", F.when(F.coalesce(gap >= gap_ms if at_gap else gap > gap_ms, F.lit(True)), F.col(ts)))
    d = before_span(d, keys, {"_old": F.max("_cut")}, {"_old": F.max})
    return d.withColumn("_piece", F.coalesce(F.max("_cut").over(inside), F.col("_old"))).drop("_span", "_hi", "_cut", "_old")


def number(df: DataFrame, keys: tuple[str, ...], ts: str, order: tuple[str, ...], span_ms: int = SPAN_MS) -> DataFrame:
    """``df`` with ``_at``, the gapless place of the row in its lane."""
    d = df.withColumn("_span", F.floor(F.col(ts) / span_ms))
    d = before_span(d, keys, {"_n": F.count("*")}, {"_n": F.sum})
    rank = F.row_number().over(W.partitionBy(*keys, "_span").orderBy(*order)) - 1
    return d.withColumn("_at", rank + F.coalesce("_n", F.lit(0))).drop("_span", "_n")


def running(df: DataFrame, keys: tuple[str, ...], ts: str, order: tuple[str, ...], sums: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None, span_ms: int = SPAN_MS) -> DataFrame:
    """``df`` with running sums and greatest values over its lane, the row itself included: inside a span by a window, and what was before it
    from the table of spans. Nulls do not count."""
    sums, greatest = sums or {}, greatest or {}
    d = df.withColumns({"_span": F.floor(F.col(ts) / span_ms), **{f"_v_{n}": c for n, c in (sums | greatest).items()}})
    d = before_span(d, keys, {f"_b_{n}": (F.sum if n in sums else F.max)(f"_v_{n}") for n in sums | greatest}, {f"_b_{n}": F.sum if n in sums else F.max for n in sums | greatest})
    w = W.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0)
    d = d.withColumns({
        **{n: F.coalesce(F.sum(f"_v_{n}").over(w), zero) + F.coalesce(f"_b_{n}", zero) for n in sums},
        **{n: F.greatest(F.max(f"_v_{n}").over(w), F.col(f"_b_{n}")) for n in greatest},
    })
    return d.drop("_span", *(f"_{x}_{n}" for x in "vb" for n in sums | greatest))


def with_rows_before(df: DataFrame, keys: tuple[str, ...], n: int, block: int = 4096) -> DataFrame:
    """Numbered rows in blocks (``_block``) of ``block`` rows, each with copies (``_copy``) of the ``n`` rows before it."""
    own = df.withColumns({"_block": F.floor(F.col("_at") / block), "_copy": F.lit(False)})
    again = own.where(F.col("_at") % block >= block - n).withColumns({"_block": F.col("_block") + 1, "_copy": F.lit(True)})
    return own.unionAll(again)


def fold_rows(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...], out: StructType | str, begin: Callable, step: Callable) -> DataFrame:
    """Fold the rows of each key in order: ``begin()`` makes the state, ``step(state, key, *columns)`` changes it and returns output rows.

    Keys are dealt over all tasks and read past in order, a batch at a time: no key is gathered."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(out) if isinstance(out, str) else out
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches):
        key = state = None
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    key, state = row[:n], begin()
                rows += step(state, key, *row[n:])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
