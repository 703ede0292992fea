"""Keyed folds over streams: one value of state a key, rows in order of event time, timers for silence."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Keeps a JSON state for each key.

    ``step(state, row)`` changes the state and returns output rows. ``due(state)`` says at which event time
    (ms) ``late(state, now)`` wants to be called if nothing more comes; it returns output rows too, and the
    state is dropped if it is then empty. Without ``due`` a state can have a time to live, ``ttl_ms`` of the wall clock from
    its last change. Rows come in order of ``order`` within a batch; a batch's rows of a key are one group, so the
    stream's trigger should be limited (``read_table``)."""

    def __init__(self, fields, order, columns, step: Callable, due: Callable | None = None, late: Callable | None = None, ttl_ms: int | None = None):
        self.fields, self.order, self.columns, self.step, self.due, self.late, self.ttl_ms = fields, order, columns, step, due, late, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string", **({"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}))

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def _save(self, state: dict) -> None:
        if self.due:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if not state:
            self.state.clear()
            return
        self.state.update((json.dumps(state),))
        if self.due and (at := self.due(state)) is not None:
            self.handle.registerTimer(int(at))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        batch = pd.concat(list(rows)).sort_values(self.order)
        for row in batch[self.fields].itertuples(index=False):
            out += [(*key, *r) for r in self.step(state, row)]
        self._save(state)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        if self.late and state:
            out = [(*key, *r) for r in self.late(state, expiredTimerInfo.getExpiryTimeInMs())]
            self._save(state)
        yield self._frame(out)

    def close(self) -> None:
        pass


def fold(df: DataFrame, keys: list[str], order: list[str], out: str, step: Callable, due: Callable | None = None, late: Callable | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Apply a :class:`Fold` to a stream; with ``due`` it must have a watermark."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = [f.strip().split()[0] for f in out.split(",")]
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).transformWithStateInPandas(Fold(fields, order, columns, step, due, late, None if due else ttl_ms), outputStructType=out, outputMode="Append", timeMode="eventTime" if due else "processingTime" if ttl_ms else "none")
