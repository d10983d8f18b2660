"""Jobs, claims and gates as streams: rows of a key followed in event time order, with state that survives restarts.

Each operator has the step of its batch form (``operators.events``).  Rows wait in the key's state until the watermark has
passed them and are then taken in order, so that the result is the same for every split into micro-batches, as long as no
row is later than the watermark's delay.  One timer a key wakes it at the earliest row that waits.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegralType, StructType, TimestampNTZType, TimestampType

from quillgraph.operators.events import claim_step, job_step, micros

#: Sessions that run these need it: ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Follows a key's rows in order of (``ts``, ``tie``).

    ``step``: memory and row to memory and value; the memory is anything that JSON can hold.  ``holds``: of the memory,
    whether rows of the kind ``held`` must wait on (a gate that is shut); those go on when it opens.  ``idle_at``: of the
    memory, the microsecond from which on it says nothing any more and may be forgotten.
    """

    def __init__(
        self, keys: list[str], schema: StructType, tie: str, step: Callable[[Any, dict], tuple[Any, Any]], out: str, holds: Callable[[Any, dict], bool] | None = None, idle_at: Callable[[Any], int] | None = None
    ):
        self.keys, self.schema, self.tie, self.step, self.out, self.holds, self.idle_at = keys, schema, tie, step, out, holds, idle_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([f for f in self.schema if f.name not in self.keys]))
        self.memory = handle.getValueState("memory", "m string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        fields = [f for f in self.schema if f.name not in self.keys]
        names = [f.name for f in fields]
        plain = [int if isinstance(f.dataType, IntegralType) else pd.Timestamp.to_pydatetime if isinstance(f.dataType, (TimestampType, TimestampNTZType)) else None for f in fields]
        for frame in rows:  # whole numbers with gaps come as floats
            columns = [[None if gone else make(x) if make else x for x, gone in zip(frame[n], frame[n].isna(), strict=True)] for n, make in zip(names, plain, strict=True)]
            self.waiting.appendList(list(zip(*columns, strict=True)))
        self._wake([micros(r[names.index("ts")]) for r in self.waiting.get()])
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = [f.name for f in self.schema if f.name not in self.keys]
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [dict(zip(names, r, strict=True)) for r in self.waiting.get()]
        rows.sort(key=lambda r: (micros(r["ts"]), r[self.tie]))
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else None
        ready, later, held, out = [r for r in rows if micros(r["ts"]) <= upto], [r for r in rows if micros(r["ts"]) > upto], [], []
        for row in ready:
            if self.holds and self.holds(memory, row):
                held.append(row)
                continue
            memory, value = self.step(memory, row)
            out.append((row, value))
            if held and not self.holds(memory, held[0]):
                for old in held:
                    memory, value = self.step(memory, old)
                    out.append((old, value))
                held = []
        left = held + later
        self.waiting.put([tuple(r[n] for n in names) for r in left]) if left else self.waiting.clear()
        if memory is not None and not left and self.idle_at and self.idle_at(memory) <= upto:
            memory = None
        self.memory.update((json.dumps(memory),)) if memory is not None else self.memory.clear()
        self._wake([micros(r["ts"]) for r in later] or ([self.idle_at(memory)] if memory is not None and self.idle_at and not held else []))
        if out:
            yield pd.DataFrame([dict(zip(self.keys, key, strict=True)) | row | {self.out: value} for row, value in out], dtype=object)

    def _wake(self, times: list[int]) -> None:
        """One timer, at the first of ``times`` (microseconds), rounded up to a millisecond."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(-(-max(min(times), 0) // 1000))

    def close(self) -> None:
        pass


def ordered_stream(rows: DataFrame, keys: list[str], tie: str, step: Callable, out: str, delay: str, **more: Any) -> DataFrame:
    """A stream with one more column, ``out`` ("name type"): ``InOrder`` over each key's rows.  ``ts`` is a timestamp."""
    column = StructType.fromDDL(out)
    name, kept = column[0].name, rows.drop(column[0].name)
    watched = kept.withWatermark("ts", delay)
    processor = InOrder(keys, kept.schema, tie, step, name, **more)
    order = StructType([kept.schema[k] for k in keys] + [f for f in kept.schema if f.name not in keys] + column.fields)
    return watched.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=order, outputMode="Append", timeMode="EventTime")


def _job(memory: list | None, row: dict) -> tuple[list, Any]:
    running, job = job_step(tuple(memory) if memory else None, row)
    return list(running), job


def job_stream(requests: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``operators.events.distinct_jobs`` of a stream: requests with the ``job_id`` that serves them.

    State: the job that runs and the requests the watermark hasn't passed; forgotten when the job has ended.
    """
    kind = dict(requests.dtypes)["request_id"]
    return ordered_stream(requests, ["workspace", "type"], "request_id", _job, f"job_id {kind}", delay, idle_at=lambda memory: memory[1])


def claim_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``operators.events.claims_in_order`` of a stream.  A key that is claimed stays so until it is released."""
    return ordered_stream(events, ["key"], "event_id", claim_step, "outcome string", delay)


def gate_step(shut: bool | None, row: dict) -> tuple[bool, str]:
    """One event of a workspace: ``pause`` and ``resume`` move the gate, anything else passes."""
    if row["kind"] in ("pause", "resume"):
        return row["kind"] == "pause", row["kind"]
    return bool(shut), "passed"


def _held(shut: bool | None, row: dict) -> bool:
    return bool(shut) and row["kind"] not in ("pause", "resume")


def gate_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Events (event_id, workspace, kind, ts) with ``outcome``: those of a paused workspace wait in its state and pass, in order, when it is resumed."""
    return ordered_stream(events, ["workspace"], "event_id", gate_step, "outcome string", delay, holds=_held)
