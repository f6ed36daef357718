"""Rows of a key in the order of events, on a stream, by state with timers.

A row waits in the state of its key until the watermark has passed its slot (a few
seconds of event time), so rows that come late, within the allowed delay, take
their place. Every batch puts its rows under keys of their own in a map, one for
each slot: a flooded key writes its new rows only, and when a slot is due no other
slot is read. What a key carries from row to row is one value, dropped once the key
has been quiet for a time that the caller sets.

The state lives in RocksDB (``session.SETTINGS``).
"""
from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOT_MS = 5000
Step = Callable[[tuple, pd.DataFrame, object], tuple[pd.DataFrame, object]]


def _ms(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64") // 1000


class InOrder(StatefulProcessor):
    """Calls ``step(key, rows, carried)`` for rows that are due, ordered by time and ``tie``; it gives what
    goes out and what is carried on. Nothing is carried before the first rows: ``None``. Once a key has been
    quiet for ``keep_ms``, ``end(key, carried)`` may give last rows before its value is dropped."""

    def __init__(self, step: Step, tie: str, keep_ms: int, end: Callable[[tuple, object], pd.DataFrame] | None = None):
        self.step, self.tie, self.keep_ms, self.end = step, tie, keep_ms, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint, part string", "rows binary")
        self.carried = handle.getValueState("carried", "value binary, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts: dict[int, list[pd.DataFrame]] = {}
        for pdf in rows:
            for slot, some in pdf.groupby(_ms(pdf["timestamp"]) // SLOT_MS):
                parts.setdefault(int(slot), []).append(some)
        for slot, some in parts.items():
            self.waiting.updateValue((slot, uuid.uuid4().hex), (pickle.dumps(pd.concat(some, ignore_index=True)),))
            self.handle.registerTimer((slot + 1) * SLOT_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        keys = list(self.waiting.keys())
        due = [k for k in keys if (k[0] + 1) * SLOT_MS <= passed]
        value, last_ms = self.carried.get() if self.carried.exists() else (None, None)
        if due:
            rows = pd.concat([pickle.loads(self.waiting.getValue(k)[0]) for k in due], ignore_index=True)
            for k in due:
                self.waiting.removeKey(k)
            rows = rows.sort_values(["timestamp", self.tie], ignore_index=True)
            out, carried = self.step(key, rows, None if value is None else pickle.loads(value))
            last_ms = int(_ms(rows["timestamp"]).iloc[-1])
            self.carried.update((pickle.dumps(carried), last_ms))
            self.handle.registerTimer(max(last_ms + self.keep_ms, passed + 1))
            if len(out):
                yield out
        elif len(due) == len(keys) and last_ms is not None and last_ms + self.keep_ms <= passed:
            self.carried.clear()
            if self.end is not None:
                out = self.end(key, pickle.loads(value))
                if len(out):
                    yield out

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, tie: str, schema: str, step: Step, keep_ms: int,
             end: Callable[[tuple, object], pd.DataFrame] | None = None, time: str = "") -> DataFrame:
    """Applies ``step`` to a stream with a watermark on ``timestamp``; ``time`` names the time of what goes out, for
    operators that follow."""
    return rows.groupBy(key).transformWithStateInPandas(InOrder(step, tie, keep_ms, end), schema, "append", "EventTime",
                                                        eventTimeColumnName=time)
