"""Keyed state over a stream in the order of the rows' own times, with timers that let go of it.

Rows of a key wait in state until the watermark has passed them and are then folded in order, so that the result does not depend
on how the stream was cut into batches, as long as rows are no later than the watermark allows. A fold says when it wants to be
woken without a row, and returns None as its state when there is nothing to remember: the key then leaves the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

#: fold(key, rows in order, kept state or None, time up to which all is known) -> (rows to emit, state to keep or None, when to wake or None).
#: Times are microseconds; rows and states are tuples.
Fold = Callable[[Any, list[tuple], tuple | None, int], tuple[list[tuple], tuple | None, int | None]]


class InOrder(StatefulProcessor):
    """Applies a fold to the rows of each key in the order (at, the rest of the row)."""

    def __init__(self, fold: Fold, row: StructType, kept: StructType, out: list[str]) -> None:
        self.fold, self.row, self.kept_type, self.out = fold, row, kept, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.kept = handle.getValueState("kept", self.kept_type)
        self.alarm = handle.getValueState("alarm", "at long")

    def _wake_at(self, us: int | None) -> None:
        """One timer a key: the earliest moment at which there is something to do."""
        old = self.alarm.get()
        ms = None if us is None else -(-us // 1000)
        if old is not None and old[0] == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old[0])
            self.alarm.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for pdf in rows for r in pdf.itertuples(index=False, name=None)]
        new = [tuple(None if x is pd.NaT or isinstance(x, float) and x != x else x for x in r) for r in new]
        for r in new:
            self.waiting.appendValue(r)
        alarm = self.alarm.get()
        first = min(r[0] for r in new)
        if alarm is None or -(-first // 1000) < alarm[0]:
            self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.alarm.clear()
        known = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= known), key=lambda r: tuple((x is not None, x) for x in r))
        rest = [r for r in rows if r[0] > known]
        emitted, kept, wake = self.fold(key, due, self.kept.get() if self.kept.exists() else None, known)
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if kept is None:
            self.kept.clear()
        else:
            self.kept.update(kept)
        alarms = [r[0] for r in rest] + ([] if wake is None else [max(wake, known + 1000)])
        self._wake_at(min(alarms, default=None))
        if emitted:
            yield pd.DataFrame(emitted, columns=self.out)


def in_order(rows: DataFrame, key: str, at: str, columns: list[str], fold: Fold, kept: str, out: str, late: str) -> DataFrame:
    """The fold's rows (schema `out`) over a stream of rows(key, at timestamp, columns); rows more than `late` behind are dropped.

    Needs the RocksDB state store: set spark.sql.streaming.stateStore.providerClass before the query starts.
    """
    timed = rows.withWatermark(at, late).select(key, F.unix_micros(at).alias("at_us"), *columns, F.col(at).alias("_at"))
    row = timed.select("at_us", *columns).schema
    schema = _parse_datatype_string(out)

    def strip(pdf_fold: Fold) -> Fold:
        return lambda k, due, state, known: pdf_fold(k[0], due, state, known)

    class Strip(InOrder):
        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            names = ["at_us", *columns]
            return super().handleInputRows(key, (pdf[names] for pdf in rows), timerValues)

    return timed.groupBy(key).transformWithStateInPandas(Strip(strip(fold), row, _parse_datatype_string(kept), schema.names), schema, "append", "EventTime")


def ordered_batch(rows: DataFrame, key: str, at: str, columns: list[str], fold: Fold, out: str, until: str | None = None) -> DataFrame:
    """The batch twin: the same fold over the whole history of each key, up to the time `until` (default: everything, all timers run
    out). Rows of a null key are left out."""
    end = int(pd.Timestamp(until).value // 1000) if until else 1 << 62
    schema = to_arrow_schema(_parse_datatype_string(out), timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys lie together in order; one key's rows are held at a time."""
        own, due, emitted = None, [], []
        for batch in batches:
            for k, *r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if due and k != own:
                    emitted += fold(own, due, None, end)[0]
                    due = []
                own = k
                if r[0] <= end:
                    due.append(tuple(r))
            if len(emitted) > 10_000:
                yield _batch(emitted, schema)
                emitted = []
        if due:
            emitted += fold(own, due, None, end)[0]
        if emitted:
            yield _batch(emitted, schema)

    timed = rows.filter(F.col(key).isNotNull()).select(key, F.unix_micros(at).alias("at_us"), *columns)
    return timed.repartition(key).sortWithinPartitions(key, "at_us", *columns).mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
