"""Tables that change while a stream runs: maps, presets, shapes.

A file table joined to a stream is listed once, so its changes never reach the stream. Here the changes are a stream themselves:
facts and changes are one keyed stream, the versions of a key are its state, and a fact takes the newest version at or before its own
time, which in batch is an as-of join."""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folds import fold

#: A device or source that says nothing for a day is forgotten.
FORGET_MS = 86_400_000
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "true"}


def newest_at(versions: list, at: int, ttl_ms: int | None):
    """The value of the newest of ``versions`` ([time, number, value], sorted) at or before ``at``, if it is not yet ``ttl_ms`` old."""
    k = bisect_right(versions, at, key=lambda v: v[0])
    if not k or ttl_ms is not None and at - versions[k - 1][0] >= ttl_ms:
        return None
    return versions[k - 1][2]


def add_version(versions: list, version: list, keep_ms: int) -> None:
    """Insert a version (a second one of one time and number replaces the first), and drop those that no fact of the last ``keep_ms`` can ask for."""
    versions[:] = [v for v in versions if v[:2] != version[:2]]
    insort(versions, version, key=lambda v: v[:2])
    old = bisect_right(versions, versions[-1][0] - keep_ms, key=lambda v: v[0])
    del versions[: max(0, old - 1)]


def with_live(facts: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], ts: str = "ts_ms", number: str | None = None, ttl_ms: int | None = None, keep_ms: int = 60_000, salts: int = 8, forget_ms: int | None = FORGET_MS) -> DataFrame:
    """The stream ``facts`` with ``columns`` of the newest version that the stream ``changes`` has of its key at or before its own
    time ``ts`` (ms); of two of one time the one with the greater ``number``. A version counts for ``ttl_ms`` (for good by default); one with nulls
    in all columns takes the key's value away.

    A change reaches the facts of its own batch and of all later ones. Versions that a newer one replaced are kept ``keep_ms`` more, for facts that
    come late; older facts get the oldest version left if it is not newer than they are, else nothing. Facts of a key are dealt over ``salts``
    states, and a change goes to each of them, so that a hot key is not one task. A key's state is forgotten ``forget_ms`` after its last row,
    by the wall clock; a run over what is there passes None (a state with a time to live keeps a query going).

    Facts travel as one text each, so that rows of any type come through (a null key has the versions of the null key)."""
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    fact_type, value_type = facts.schema, StructType([changes.schema[c] for c in columns])
    own = lambda df: [F.col(f"`{k}`").cast("string").alias(n) for n, k in named.items()]
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in facts.columns)), _JSON)
    salt = F.pmod(F.xxhash64(text), F.lit(salts)).cast("int")
    f = facts.select(*own(facts), salt.alias("__salt"), F.col(ts).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("number"), text.alias("text"))
    gone = F.lit(True)
    for c in columns:
        gone = gone & F.col(f"`{c}`").isNull()
    value = F.when(~gone, F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), _JSON))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    c = changes.select(*own(changes), every.alias("__salt"), F.col(ts).cast("long").alias("at"), F.lit(0).alias("kind"), F.col(number).cast("long").alias("number") if number else F.lit(0).cast("long").alias("number"), value.alias("text"))

    def step(state, r):
        versions = state.setdefault("v", [])
        text = None if r.text is None or r.text != r.text else r.text
        if r.kind == 0:
            add_version(versions, [int(r.at), int(r.number), text], keep_ms)
            return []
        return [(text, newest_at(versions, int(r.at), ttl_ms))]

    out = ", ".join([*(f"{n} string" for n in named), "__salt int", "fact string", "value string"])
    found = fold(f.unionByName(c), [*named, "__salt"], ["at", "kind", "number"], out, step, ttl_ms=forget_ms)
    row, held = F.from_json("fact", fact_type, _JSON).alias("f"), F.from_json("value", value_type, _JSON).alias("v")
    return found.select(row, held).select(*(F.col(f"f.`{c}`") for c in facts.columns if c not in columns), *(F.col(f"v.`{c}`") for c in columns))


def as_of(facts: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], ts: str = "ts_ms", number: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """What :func:`with_live` says of tables: see :func:`gateflow.operators.asof.last_before`."""
    from ..operators.asof import last_before

    order = (ts, number) if number else (ts,)
    rest = facts.drop(*[c for c in columns if c in facts.columns])
    found = last_before(rest, changes.select(*keys, *order, *columns), tuple(keys), ts, order, "_version")
    if ttl_ms is not None:
        found = found.withColumn("_version", F.when(F.col(ts) - F.col(f"_version.{ts}") < ttl_ms, F.col("_version")))
    return found.select(*rest.columns, *(F.col(f"_version.{c}").alias(c) for c in columns))
