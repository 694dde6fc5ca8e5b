"""Streams with several state variables and timers: session segments, a sample every second, counters that restart warm.

State lies in RocksDB and in Spark's checkpoint, so a lost executor's part is read back by another. Each key's state is bounded by time, not by the length of the run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyloom.operators.rate import US
from tallyloom.schemas import FUTURE_SLACK_SECONDS, SHORT_WINDOW_SECONDS, STALE_SECONDS, WINDOW_SECONDS
from tallyloom.streaming.live import INHERITED_PREFIX_US, INTERVALS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
USERS = ("user", "synthetic_user")


def use_state_store(spark: SparkSession) -> None:
    """State with several variables and timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# -- sessions ------------------------------------------------------------------------------------

SEGMENTS = "source string, session_hash string, segment long, first_ms long, last_ms long"


class SegmentProcessor(StatefulProcessor):
    """Rows wait until the watermark has passed them, then they are gone through in order; only those, and the open segment, are state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts_ms long, rank int, event_id string", "there boolean")
        self.open = handle.getValueState("open", "segment long, first_ms long, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = None
        for r in rows:
            self.waiting.updateValue((r.ts_ms, 0 if r.role in USERS else 1, r.event_id), (True,))
            newest = r.ts_ms if newest is None else max(newest, r.ts_ms)
        if newest is not None:
            self.handle.registerTimer(newest + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sure = timerValues.getCurrentWatermarkInMs()
        ready = sorted(k for k in self.waiting.keys() if k[0] < sure)
        segment, first, last = self.open.get() if self.open.exists() else (0, None, None)
        touched: dict[int, tuple] = {}
        for k in ready:
            if k[1] == 0:
                segment, first, last = segment + 1, None, None
            elif segment:
                first, last = k[0] if first is None else first, k[0]
                touched[segment] = (first, last)
            self.waiting.removeKey(k)
        if ready:
            self.open.update((segment, first, last))
        for s, (a, b) in touched.items():
            yield Row(source=key[0], session_hash=key[1], segment=s, first_ms=a, last_ms=b)

    def close(self) -> None:
        pass


def session_segments(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``(source, session_hash, segment, first_ms, last_ms)``: a row for each segment each time it has grown, in update mode; the last of a segment is what ``sessions.segments`` has of it.

    ``events`` is a stream with source, session_hash, role, ts_ms and a unique event_id. Rows may come in any order and any batches, up to ``late`` behind the newest; those that come later are dropped.
    """
    use_state_store(events.sparkSession)
    rows = events.select("source", "session_hash", "role", "ts_ms", "event_id", F.timestamp_millis("ts_ms").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("source", "session_hash").transformWithState(SegmentProcessor(), SEGMENTS, "Update", "eventTime")


def latest_segments(updates: DataFrame) -> DataFrame:
    """The segments as they are now, from all rows that ``session_segments`` has written."""
    return updates.groupBy("source", "session_hash", "segment").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


# -- a sample every second -----------------------------------------------------------------------

SAMPLES = "host string, tick_us long, state string, tps double, tokens_180 double, tokens_5 double, tokens_1 double, latest_us long"


def window_tokens(tick: int, intervals: list[tuple[int, int, int]], seconds: int, slack: int, rounded: bool = True) -> float:
    """Tokens of the (start, end, tokens) that meet [tick - seconds, tick + slack], by their share inside; instants count whole, but without slack not at the left edge."""
    low, high, total = tick - seconds * US, tick + slack * US, 0.0
    for start, end, tokens in intervals:
        if start > high or end < low or (not rounded and end == start == low):
            continue
        if end <= start:
            total += tokens
        else:
            part = tokens * min(1.0, (min(end, high) - max(start, low)) / (end - start))
            total += math.floor(part + 0.5) if rounded else part
    return total


def sample(host: str, tick: int, intervals: list[tuple[int, int, int]], latest: int | None, stale_seconds: int = STALE_SECONDS) -> Row:
    """The sample of the second ``tick``; ``latest`` is the last signal at or before it."""
    wide = window_tokens(tick, intervals, WINDOW_SECONDS, FUTURE_SLACK_SECONDS)
    state = "no_data" if latest is None else "stale" if tick - latest > stale_seconds * US else "live" if wide > 0 else "zero"
    shown = state in ("live", "zero")
    figures = (wide, window_tokens(tick, intervals, SHORT_WINDOW_SECONDS, FUTURE_SLACK_SECONDS), window_tokens(tick, intervals, 1, 0, rounded=False)) if shown else (None,) * 3
    return Row(host=host, tick_us=tick, state=state, tps=figures[0] / WINDOW_SECONDS if shown else None, tokens_180=figures[0], tokens_5=figures[1], tokens_1=figures[2], latest_us=latest)


class SecondProcessor(StatefulProcessor):
    """A timer for the next second, set anew each time; what a slow batch has missed is made up for."""

    def __init__(self, stale_seconds: int):
        self.stale_seconds = stale_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "start_us long, end_us long, tokens long")
        self.clock = handle.getValueState("clock", "tick_s long, latest_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.recent.appendList([(r.start_us, r.end_us, r.tokens) for r in rows if r.tokens > 0 and r.end_us >= r.start_us])
        if not self.clock.exists():
            now_s = timerValues.getCurrentProcessingTimeInMs() // 1000
            self.clock.update((now_s, None))
            self.handle.registerTimer((now_s + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_s = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()) // 1000
        done, latest = self.clock.get()
        intervals = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        for s in range(done + 1, now_s + 1):
            latest = max((end for _, end, _ in [*intervals, (None, latest, None)] if end is not None and end <= s * US), default=None)
            yield sample(key[0], s * US, intervals, latest, self.stale_seconds)
        kept = [r for r in intervals if r[1] >= (now_s - WINDOW_SECONDS) * US]
        self.recent.put(kept) if kept else self.recent.clear()
        self.clock.update((now_s, latest))
        self.handle.registerTimer((now_s + 1) * 1000)

    def close(self) -> None:
        pass


def second_samples(intervals: DataFrame, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """A sample of each host for each second from its first interval on, also while nothing arrives (``SAMPLES``).

    ``intervals`` is a stream with host, start_us, end_us and tokens. State is the intervals of the last 180 s, so a batch costs as much after a week as after an hour. Start the query with
    a trigger of a second; seconds that pass during a longer batch have their samples when it ends. An interval that comes late counts from the next sample on.
    """
    use_state_store(intervals.sparkSession)
    rows = intervals.select(F.coalesce("host", F.lit("")).alias("host"), "start_us", "end_us", "tokens")
    return rows.groupBy("host").transformWithState(SecondProcessor(stale_seconds), SAMPLES, "Append", "processingTime")


# -- counters ------------------------------------------------------------------------------------

COUNTER_STATE = "file_id string, total long, at_us long, model string"


class CounterProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", "total long, at_us long, model string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.counter.update((initialState.total, initialState.at_us, initialState.model))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, at, model = self.counter.get() if self.counter.exists() else (None, None, None)
        got = sorted(rows, key=lambda r: r.line_no)
        model = model or next((r.model for r in got if r.model), None)
        for r in got:
            model = r.model or model
            if r.total is None:
                continue
            inherited = r.meta_us is not None and r.at_us - r.meta_us < INHERITED_PREFIX_US
            if total is not None and not inherited and total < r.total and 0 <= r.at_us - at <= WINDOW_SECONDS * US:
                yield Row(file_id=key[0], start_us=at, end_us=r.at_us, tokens=r.total - total, model=model or "unknown")
            total, at = r.total, r.at_us
        self.counter.update((total, at, model))

    def close(self) -> None:
        pass


def counter_stream(rows: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``live.counter_intervals`` that can start from where another query ended: ``initial`` (``COUNTER_STATE``) is given to the first batch of a fresh checkpoint
    (whose file sink must be fresh as well: a sink skips batch numbers that it has).

    A file that is known there goes on from its last total, so no growth is counted twice and none is missed; all other files begin with a baseline.
    """
    use_state_store(rows.sparkSession)
    start = None if initial is None else initial.select("file_id", "total", "at_us", "model").groupBy("file_id")
    return rows.groupBy("file_id").transformWithState(CounterProcessor(), INTERVALS, "Append", "none", start)


def stored_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counters that the query of ``checkpoint`` has stored last (``COUNTER_STATE``). Save them before the checkpoint goes."""
    rows = spark.read.format("statestore").option("stateVarName", "counter").load(checkpoint)
    return rows.select(F.col("key.file_id").alias("file_id"), "value.total", "value.at_us", "value.model")
