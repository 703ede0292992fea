"""Folds over lanes that never pause, made parallel by speculation.

The state that such a fold carries forgets: what is long past matters to it no more. So a lane is cut into chunks of time, and each chunk is folded
from an empty state that begins a while before it. Where chunks meet, the state that a chunk began with must be the one
that the chunk before ended with; the first chunk's is right, so where all agree all are. The chunks that do not agree are run again from the state
before them, all at once, a few times; what is not settled then is folded on from the first that is wrong, in one run a lane."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .stages import stage

CHUNK_MS, WARM_MS, ROUNDS = 600_000, 60_000, 3


def speculative_fold(
    df: DataFrame, key: str, ts: str, order: tuple[str, ...], columns: tuple[str, ...], out: str, begin: Callable, step: Callable, dump: Callable, load: Callable,
    chunk_ms: int = CHUNK_MS, warm_ms: int = WARM_MS, rounds: int = ROUNDS, told: Callable | None = None,
) -> DataFrame:
    """Fold the rows of each ``key`` in ``order``, which begins with the time ``ts``: ``begin()`` makes the state, ``step(state, *columns)`` changes it and returns
    output rows. ``dump(state, at)`` is the state as text as far as rows from ``at`` on can tell it from others, and ``load`` the way back.

    Rows are dealt by (key, chunk); each chunk also gets the rows ``warm_ms`` before it. ``told``, if given, is called after each round with how
    many chunks were wrong. Null keys are a key of their own; an empty table gives an empty result."""
    fields = StructType.fromDDL(out)
    names = [f.name for f in fields]
    rows = df.select(F.col(key).cast("long").alias("_key"), F.floor(F.col(ts) / chunk_ms).alias("_chunk"), F.col(ts).cast("long").alias("_ts"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    rows = stage(rows)
    values, by = [f"_c{i}" for i in range(len(columns))], [f"_o{i}" for i in range(len(order))]
    own = rows.withColumns({"_kind": F.lit(2), "_state": F.lit(None).cast("string")})
    warm = own.where(F.col("_ts") >= (F.col("_chunk") + 1) * chunk_ms - min(warm_ms, chunk_ms)).withColumns({"_chunk": F.col("_chunk") + 1, "_kind": F.lit(1)})
    result = StructType([StructField("_key", LongType()), StructField("_chunk", LongType()), StructField("_first", LongType()), StructField("_in", StringType()), StructField("_out", StringType()), *fields])
    arrow = to_arrow_schema(result)

    def run(batches):
        group = state = first = before = None
        done: list[tuple] = []
        blank = (None,) * len(names)

        def emit():
            nonlocal done
            done, rows = [], done
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        def end():
            if group is not None and first is not None:
                done.append((*group, first, before, dump(state, None), *blank))

        for batch in batches:
            for k, chunk, kind, at, given, *value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, chunk) != group:
                    end()
                    group, state, first = (k, chunk), begin(), None
                if kind == 0:
                    state = load(given)
                    continue
                if kind == 2 and first is None:
                    first, before = at, dump(state, at)
                made = step(state, *value)
                if kind == 2:
                    done += [(*group, None, None, None, *r) for r in made]
            if done:
                yield emit()
        end()
        if done:
            yield emit()

    def folded(some: DataFrame) -> DataFrame:
        dealt = some.select("_key", "_chunk", "_kind", "_ts", "_state", *values, *by).repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_kind", *by)
        return dealt.select("_key", "_chunk", "_kind", "_ts", "_state", *values).mapInArrow(run, result)

    def meets(end: str, at: int, start: str) -> bool:
        return dump(load(end), at) == start

    agrees = F.arrow_udf(lambda end, at, start: pa.array([meets(*r) for r in zip(end.to_pylist(), at.to_pylist(), start.to_pylist(), strict=True)]), "boolean")
    lane = W.partitionBy("_key").orderBy("_chunk")

    def wrong(done: DataFrame) -> DataFrame:
        """(key, chunk, state): chunks that did not begin with the state that the one before ended with, and that state."""
        ends = done.where("_first is not null").select("_key", "_chunk", "_first", "_in", F.lag("_out").over(lane).alias("_before"))
        return ends.where(F.col("_before").isNotNull() & ~agrees("_before", "_first", "_in")).select("_key", "_chunk", F.col("_before").alias("_state"))

    at = lambda a, b: [F.col(f"{a}._key").eqNullSafe(F.col(f"{b}._key")), F.col(f"{a}._chunk") == F.col(f"{b}._chunk")]
    starting = lambda w: w.select("_key", "_chunk", "_state", F.lit(0).alias("_kind"))
    # a chunk without rows of its own has only copies, and tells nothing
    done = stage(folded(own.unionByName(warm)))
    bad = stage(wrong(done))
    n = bad.count()
    for _ in range(rounds):
        if told:
            told(n)
        if not n:
            break
        again = own.alias("r").join(bad.alias("b"), at("r", "b"), "left_semi").unionByName(starting(bad), allowMissingColumns=True)
        done = stage(done.alias("d").join(bad.alias("b"), at("d", "b"), "left_anti").unionAll(folded(again)))
        bad = stage(wrong(done))
        n = bad.count()
    else:
        if n:  # in one run a lane, from the first chunk that is wrong
            first = bad.groupBy("_key").agg(F.min_by(F.struct("_chunk", "_state"), "_chunk").alias("s")).select(F.col("_key").alias("_of"), F.col("s._chunk").alias("_from"), F.col("s._state").alias("_state"))
            rest = own.drop("_state").join(first.drop("_state"), F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_chunk") >= F.col("_from"))).withColumn("_chunk", F.col("_from")).drop("_of", "_from")
            head = first.select(F.col("_of").alias("_key"), F.col("_from").alias("_chunk"), "_state", F.lit(0).alias("_kind"))
            good = done.join(first.drop("_state"), F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_chunk") >= F.col("_from")), "left_anti")
            done = good.unionAll(folded(rest.unionByName(head, allowMissingColumns=True)))
    return done.where("_first is null").select(*names)
