"""Pacing of requests over two models, live and over a table.

A caller's requests are taken in order.  Each goes to the primary model or, while
that has no slot, to the fallback at once; while neither has one, it waits for
the one that is free first.  A slot is free while fewer than ``rpm`` requests of
the last minute and ``rpd`` of the Pacific day went to a model, and it is not
cooling down.  Answers come back as rows: a per-minute refusal cools its model
down, a daily one parks it until the day turns.  While both are parked requests
are turned down, but for a probe now and then; a probe that is answered brings
both models back.

Rows are (caller, at, kind, request_id, model, retry_ms), ``at`` a timestamp and
``kind`` one of request, minute_limit, daily_limit, ok.  Given are (caller,
request_id, model, sent_at, outcome): ``outcome`` is granted, probe, or
unavailable with a null model; ``sent_at`` is in milliseconds.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from functools import lru_cache
from typing import Any
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Requests of a model within a minute and a day, and time between probes.
RPM, RPD, PROBE_MS = 15, 500, 30 * 60_000
MODELS = ("primary", "fallback")
MINUTE_MS, MARGIN_MS, LEAST_WAIT_MS, LONGEST_WAIT_MS = 60_000, 250, 250, 61_000
OUT = "caller string, request_id long, model string, sent_at long, outcome string"
_PACIFIC = ZoneInfo("America/Los_Angeles")
_NEVER = float("inf")


def pacific_day(ms: int) -> str:
    """The Pacific date of a time."""
    return _day_of_minute(ms // MINUTE_MS) if ms >= 0 else datetime.fromtimestamp(ms / 1000, _PACIFIC).date().isoformat()


@lru_cache(maxsize=4_096)
def _day_of_minute(minute: int) -> str:
    """Days begin at whole minutes (since 1883), and few minutes are looked at
    at a time."""
    return datetime.fromtimestamp(minute * 60, _PACIFIC).date().isoformat()


@dataclass
class Model:
    """What is known of one model."""

    window: list[int] = field(default_factory=list)
    used: int = 0
    day: str = ""
    parked: bool = False
    cool_until: int = 0

    def roll(self, now: int) -> None:
        """A new day starts afresh."""
        today = pacific_day(now)
        if today != self.day:
            self.__init__(day=today)

    def wait(self, now: int, rpm: int, rpd: int) -> float:
        """Milliseconds until it may take a request."""
        self.roll(now)
        self.parked |= self.used >= rpd
        if self.parked:
            return _NEVER
        self.window = [t for t in self.window if now - t < MINUTE_MS]
        full = 0 if len(self.window) < rpm else MINUTE_MS - (now - self.window[0]) + MARGIN_MS
        return max(full, self.cool_until - now, 0)


@dataclass
class Rotation:
    """The state of one caller."""

    rpm: int
    rpd: int
    probe_ms: int
    models: list[Model] = field(default_factory=lambda: [Model(), Model()])
    queue: deque[int] = field(default_factory=deque)  # the first goes in the same time however many wait
    next_try: int = 0
    probed: int = 0
    probing: int | None = None
    clock: int = 0

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.queue = deque(self.queue)  # a list in states of before

    def _send(self, request: int, now: int, k: int | None, outcome: str) -> tuple:
        if k is not None:
            m = self.models[k]
            m.roll(now)
            m.used += 1
            if outcome == "granted":
                m.window.append(now)
        return (request, None if k is None else MODELS[k], now, outcome)

    def _try(self, now: int) -> tuple | None:
        """What becomes of the first request that waits; None: it waits on."""
        waits = [m.wait(now, self.rpm, self.rpd) for m in self.models]
        request = self.queue[0]
        for k, w in enumerate(waits):
            if w == 0:
                return self._send(request, now, k, "granted")
        if min(waits) == _NEVER:
            if now - self.probed < self.probe_ms:
                return self._send(request, now, None, "unavailable")
            self.probed, self.probing = now, request
            return self._send(request, now, 0, "probe")
        self.next_try = now + int(max(LEAST_WAIT_MS, min(min(waits), LONGEST_WAIT_MS)))
        return None

    def until(self, now: int) -> list[tuple]:
        """Serve those that wait, in order, as far as time has come."""
        out = []
        while self.queue and self.next_try <= now:
            at = max(self.next_try, self.clock)
            self.clock = at
            got = self._try(at)
            if got is None:
                continue
            self.queue.popleft()
            out.append(got)
        return out

    def take(self, at: int, kind: str, request: int, model: str | None, retry_ms: int | None) -> list[tuple]:
        """What a row leads to."""
        out = self.until(at)
        self.clock = max(self.clock, at)
        if kind == "request":
            self.queue.append(request)
            if len(self.queue) == 1:
                self.next_try = at
            return out + self.until(at)
        if kind == "ok":
            if request == self.probing:
                for m in self.models:
                    m.__init__(window=m.window, day=pacific_day(at), cool_until=m.cool_until)
                self.probing = None
            return out
        m = self.models[MODELS.index(model)]
        m.roll(at)
        if kind == "daily_limit":
            m.parked = True
            if all(x.parked for x in self.models):
                self.probed = at
        else:
            m.cool_until = at + (retry_ms or 0)
        return out


_COLUMNS = ["at", "kind", "request_id", "model", "retry_ms"]


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    """Rows in order: of one time answers before requests."""
    frame = frame.assign(_later=frame["kind"] == "request").sort_values(["at", "_later", "request_id"], kind="stable")
    for at, kind, request, model, retry in frame[_COLUMNS].itertuples(index=False):
        yield int(at), kind, int(request), model, None if pd.isna(retry) else int(retry)


class RotatingPacer(StatefulProcessor):
    """``Rotation`` as a keyed state; those that wait are served by timers."""

    def __init__(self, rpm: int, rpd: int, probe_ms: int):
        self.limits = (rpm, rpd, probe_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rotation", "value binary")

    def _load(self) -> Rotation:
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else Rotation(*self.limits)

    def _store(self, caller: str, state: Rotation, out: list[tuple]) -> pd.DataFrame:
        if state.queue:
            self.handle.registerTimer(state.next_try)
        self.state.update((pickle.dumps(state),))
        return pd.DataFrame([(caller, *x) for x in out], columns=["caller", "request_id", "model", "sent_at", "outcome"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        for row in _rows(pd.concat(list(rows))):  # of one caller and batch
            out += state.take(*row)
        yield self._store(key[0], state, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self._load()
        yield self._store(key[0], state, state.until(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def pace_stream(rows: DataFrame, rpm: int = RPM, rpd: int = RPD, probe_ms: int = PROBE_MS, late: str = "0 seconds") -> DataFrame:
    """Grants for a stream of requests and answers.  A caller's requests are
    served in the order of their times within a batch; those that wait are
    served when the watermark has passed their time."""
    timed = rows.withWatermark("ts", late).select("caller", "ts", F.unix_millis("ts").alias("at"), "kind", "request_id", "model", F.col("retry_ms").cast("long").alias("retry_ms"))
    return timed.groupBy("caller").transformWithStateInPandas(RotatingPacer(rpm, rpd, probe_ms), OUT, "Append", "EventTime")


def pace_table(rows: DataFrame, rpm: int = RPM, rpd: int = RPD, probe_ms: int = PROBE_MS) -> DataFrame:
    """The same over a table; all that waits at its end is served.  A caller's
    rows stream through a task in order of time."""
    slim = rows.select("caller", F.unix_millis("ts").alias("at"), "kind", F.col("request_id").cast("long").alias("request_id"), "model", F.col("retry_ms").cast("long").alias("retry_ms"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Rotation(rpm, rpd, probe_ms)
        schema = pa.schema([("caller", pa.string()), ("request_id", pa.int64()), ("model", pa.string()), ("sent_at", pa.int64()), ("outcome", pa.string())])
        for batch in batches:
            out = []
            for caller, at, kind, request, model, retry in zip(*[batch[c].to_pylist() for c in ("caller", *_COLUMNS)], strict=True):
                if caller != now:
                    out += [(now, *x) for x in state.until(_FOREVER)]
                    now, state = caller, Rotation(rpm, rpd, probe_ms)
                out += [(caller, *x) for x in state.take(at, kind, request, model, retry)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        rest = [(now, *x) for x in state.until(_FOREVER)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rest], f.type) for i, f in enumerate(schema)], schema=schema)

    later = (F.col("kind") == "request").alias("_later")
    dealt = slim.withColumn("_later", later).repartition("caller").sortWithinPartitions("caller", "at", "_later", "request_id")
    return dealt.drop("_later").mapInArrow(fold, OUT)


_FOREVER = 1 << 62
