"""Chains of rows that each choose the next: rate limits, without a serial fold.

Of each lane a limiter lets the first row through, then the first row an interval after that, and so on. Which rows those are depends on all
before, but where a chain goes on from a given row does not: every row has one successor. Rows are numbered and cut into
chunks; inside a chunk each row's way out (the first row of its chain beyond the chunk) is read off backwards. Ways out are few, and
pointers over them are doubled: after k rounds all are marked that lie up to 2^k chunks from a start. Each chunk is then walked once from
where its chain comes in. So a lane that never pauses is spread over all tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .asof import first_after
from .lanes import number
from .stages import stage

CHUNK = 4096


def _groups(batches, n_keys: int):
    """(key, columns) of runs of rows with equal first ``n_keys`` columns, one run at a time."""
    held, key = [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*columns[:n_keys], strict=True))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                if held:
                    yield key, [sum(c, []) for c in zip(*held, strict=True)]
                held, key = [], keys[at]
            held.append([c[at:end] for c in columns[n_keys:]])
            at = end
    if held:
        yield key, [sum(c, []) for c in zip(*held, strict=True)]


def _ways_out(at: list, following: list) -> list:
    """Of each row of a chunk (places ``at``, gapless) the first place of its chain beyond the chunk, None where the chain ends."""
    low, high, out = at[0], at[-1], [None] * len(at)
    for i in range(len(at) - 1, -1, -1):
        nxt = following[i]
        out[i] = nxt if nxt is None or nxt > high else out[nxt - low]
    return out


def let_through(df: DataFrame, keys: tuple[str, ...], ts: str, order: tuple[str, ...], interval_ms: int, strict: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``df`` that a limiter lets through: of each key the first, then the next one that comes ``interval_ms`` or more
    (with ``strict``: more) after the last that went through. Null keys are a key of their own; ``order`` begins with ``ts`` and should tell
    rows apart, else equal ones are taken in any order."""
    if interval_ms < 0 or interval_ms == 0 and not strict:
        return df
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    lanes = tuple(names.values())
    rows = number(df.withColumns({n: F.col(f"`{k}`") for k, n in names.items()}), lanes, ts, order)
    rows = stage(rows.withColumns({"__due": F.col(ts) + interval_ms, "__chunk": F.floor(F.col("_at") / chunk)}))
    places = rows.select(*lanes, F.col(ts).alias("__ts"), F.col("_at").alias("__place"))
    narrow = rows.select(*lanes, "__chunk", "_at", "__due")
    linked = first_after(narrow, places, lanes, "__due", "__ts", "__n", strict).select(*lanes, "__chunk", "_at", F.col("__n.__place").alias("__next"))
    at = (*lanes, "__chunk")
    linked = stage(linked)
    sorted_rows = lambda d: d.repartition(*at).sortWithinPartitions(*at, "_at")
    n = len(at)
    kinds = [rows.schema[c] for c in lanes]
    from pyspark.sql.types import LongType, StructField, StructType

    edge = StructType([*kinds, StructField("_at", LongType()), StructField("__to", LongType())])
    edge_arrow = to_arrow_schema(edge)

    def exits(batches):
        for key, (places, following) in _groups(batches, n):
            columns = [*([k] * len(places) for k in key[:-1]), places, _ways_out(places, following)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, edge_arrow, strict=True)], schema=edge_arrow)

    out = stage(sorted_rows(linked).mapInArrow(exits, edge))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in lanes]
    targets = out.where("__to is not null").select(*lanes, F.col("__to").alias("_at")).distinct()
    starts = out.where("_at = 0").select(*lanes, "_at")
    # the nodes: where chains come into a chunk, and the lanes' first rows
    nodes = targets.unionAll(starts).distinct()
    jump = stage(out.alias("o").join(nodes.alias("n"), [*same("o", "n"), F.col("o._at") == F.col("n._at")], "left_semi"))
    reach, size = stage(starts), -1
    while (found := reach.count()) != size:
        size = found
        on = [*same("r", "j"), F.col("r._at") == F.col("j._at")]
        more = reach.alias("r").join(jump.alias("j"), on).where("__to is not null").select(*(F.col(f"r.{c}") for c in lanes), F.col("__to").alias("_at"))
        reach = stage(reach.unionAll(more).distinct())
        on = [*same("a", "b"), F.col("a.__to") == F.col("b._at")]
        jump = stage(jump.alias("a").join(jump.alias("b"), on).select(*(F.col(f"a.{c}") for c in lanes), "a._at", "b.__to"))

    came = reach.select(*(F.col(c).alias(f"__r{i}") for i, c in enumerate(lanes)), F.col("_at").alias("__in"))
    on = [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(lanes)] + [F.col("_at") == F.col("__in")]
    marked = linked.join(came, on, "left").select(*at, "_at", "__next", F.col("__in").isNotNull().alias("__enters"))
    pick = StructType([*kinds, StructField("_at", LongType())])
    pick_arrow = to_arrow_schema(pick)

    def walk(batches):
        for key, (places, following, enters) in _groups(batches, n):
            taken, due = [], None
            for place, nxt, enter in zip(places, following, enters, strict=True):
                if enter or place == due:
                    taken.append(place)
                    due = nxt
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(taken), f.type) for k, f in zip(key[:-1], pick_arrow, strict=False)), pa.array(np.array(taken, dtype=np.int64))], schema=pick_arrow)

    chosen = sorted_rows(marked).mapInArrow(walk, pick).select(*(F.col(c).alias(f"__r{i}") for i, c in enumerate(lanes)), F.col("_at").alias("__in"))
    return rows.join(chosen, on, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
