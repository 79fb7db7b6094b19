"""Keyed processes: several state variables and event-time timers for each key of a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .payload import packed, several_variables, unpacked

KINDS = ("value", "list", "map")


@dataclass(frozen=True)
class Variable:
    """A state variable: one value, a list to append to, or a map by key. ``ttl_ms`` is for processing time only."""

    kind: str = "value"
    ttl_ms: int | None = None


class _Value:
    def __init__(self, state):
        self._state = state

    def get(self, default: Any = None) -> Any:
        return json.loads(self._state.get()[0]) if self._state.exists() else default

    def put(self, value: Any) -> None:
        self._state.update((json.dumps(value),))

    def clear(self) -> None:
        self._state.clear()


class _List:
    def __init__(self, state):
        self._state = state

    def __iter__(self) -> Iterator[Any]:
        return (json.loads(row[0]) for row in self._state.get()) if self._state.exists() else iter(())

    def append(self, *values: Any) -> None:
        self._state.appendList([(json.dumps(v),) for v in values])

    def put(self, values: Sequence[Any]) -> None:
        """Replaces the whole list."""
        if values:
            self._state.put([(json.dumps(v),) for v in values])
        else:
            self._state.clear()

    def clear(self) -> None:
        self._state.clear()


class _Map:
    def __init__(self, state):
        self._state = state

    def get(self, key: Any, default: Any = None) -> Any:
        found = self._state.getValue((json.dumps(key),))
        return default if found is None else json.loads(found[0])

    def put(self, key: Any, value: Any) -> None:
        self._state.updateValue((json.dumps(key),), (json.dumps(value),))

    def remove(self, key: Any) -> None:
        self._state.removeKey((json.dumps(key),))

    def items(self) -> Iterator[tuple[Any, Any]]:
        return ((json.loads(k[0]), json.loads(v[0])) for k, v in self._state.iterator())

    def clear(self) -> None:
        self._state.clear()


class State:
    """What a process sees of a key: its variables by name, the clock, and its timers. Times are microseconds."""

    def __init__(self, handle, variables: dict[str, Variable], event_time: bool):
        self._handle, self._event_time, self.now = handle, event_time, 0
        wrap = {"value": _Value, "list": _List, "map": _Map}
        self._variables = {}
        for name, variable in variables.items():
            ttl = {"ttlDurationMs": variable.ttl_ms} if variable.ttl_ms else {}
            if variable.kind == "map":
                state = handle.getMapState(name, "k string", "body string", **ttl)
            elif variable.kind == "list":
                state = handle.getListState(name, "body string", **ttl)
            else:
                state = handle.getValueState(name, "body string", **ttl)
            self._variables[name] = wrap[variable.kind](state)

    def __getitem__(self, name: str):
        return self._variables[name]

    def wake(self, at: int) -> None:
        """Calls ``on_timer`` once the clock, the watermark or processing time, has reached ``at``; again has no effect."""
        self._handle.registerTimer(-(-at // 1000))

    def forget(self, at: int) -> None:
        """Takes a timer back."""
        self._handle.deleteTimer(-(-at // 1000))

    def _tick(self, timers) -> None:
        ms = timers.getCurrentWatermarkInMs() if self._event_time else timers.getCurrentProcessingTimeInMs()
        self.now = max(ms, 0) * 1000


class KeyedProcess:
    """To be derived: ``variables`` by name, and what happens with rows and when a timer is due.

    Rows come and go as dicts. Timestamps are microseconds since 1970 in them, decimals are floats.
    """

    variables: dict[str, Variable] = {}

    def on_rows(self, key: dict, rows: Iterator[dict], state: State) -> Iterator[dict]:
        raise NotImplementedError

    def on_timer(self, key: dict, at: int, state: State) -> Iterator[dict]:
        """``at`` is the time asked for, in whole milliseconds, rounded up."""
        return iter(())


class _Processor(StatefulProcessor):
    def __init__(self, process: KeyedProcess, event_time: bool):
        self.process, self.event_time = process, event_time

    def init(self, handle) -> None:
        self.state = State(handle, self.process.variables, self.event_time)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.state._tick(timerValues)
        given = (json.loads(text) for batch in rows for text in batch["body"])
        yield from self._frames(self.process.on_rows(json.loads(key[0]), given, self.state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state._tick(timerValues)
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        yield from self._frames(self.process.on_timer(json.loads(key[0]), at, self.state))

    @staticmethod
    def _frames(rows: Iterator[dict] | None) -> Iterator[pd.DataFrame]:
        held = []
        for row in rows or ():
            held.append(json.dumps(row))
            if len(held) >= 10_000:
                yield pd.DataFrame({"body": held})
                held = []
        if held:
            yield pd.DataFrame({"body": held})


def keyed_process(stream: DataFrame, keys: Sequence[str], process: KeyedProcess, returns: str, time: str = "event",
                  at: str | None = None) -> DataFrame:
    """Runs ``process`` for each key; columns ``returns`` (DDL) of the rows it gives.

    ``time`` is the clock of the timers: ``event`` (the watermark, which the stream must have on column ``at``; rows behind
    it are dropped), ``processing``, or ``none``. Variables with a time to live need ``processing``; a query on that clock
    looks for timers again and again, so it needs a trigger interval and ends when it is stopped. Null keys are a key; with
    event time, rows without a time are dropped. A key is one task's at a time, so a key that holds much of the data wants
    a further column in ``keys``, such as a hash of an id, and results that add up over it.
    """
    if time not in ("event", "processing", "none") or (time == "event") != (at is not None):
        raise ValueError("time is event (with at), processing or none")
    for name, variable in process.variables.items():
        if variable.kind not in KINDS or variable.ttl_ms and time != "processing":
            raise ValueError(f"variable {name}: kinds are {', '.join(KINDS)}; a time to live needs processing time")
    several_variables(stream.sparkSession)
    micros = [F.unix_micros(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.TimestampType)
              else F.unix_micros(F.col(f"`{f.name}`").cast("timestamp")).alias(f.name) if isinstance(f.dataType, T.TimestampNTZType)
              else F.col(f"`{f.name}`") for f in stream.schema]
    body = F.to_json(F.struct(*micros), {"ignoreNullFields": "false"}).alias("body")
    rows = stream.where(F.col(at).isNotNull()) if at else stream
    rows = rows.select(packed(keys).alias("who"), *([F.col(at).alias("event")] if at else []), body)
    out = T._parse_datatype_string(returns)
    mode = {"event": "eventTime", "processing": "processingTime", "none": "none"}[time]
    done = rows.groupBy("who").transformWithStateInPandas(_Processor(process, time == "event"), "body string", "append", mode)
    return done.select(unpacked("body", out.fields).alias("r")).select("r.*")
